"""Filters taken over by the job board, mail headers, mail as a stream."""

import base64
import json
import quopri

from talentspark.sources import readers


def test_job_board_takes_filters(spark, tmp_path):
    """Same rows with and without pushdown; taken filters leave the plan, others stay."""
    jobs = [{"id": i, "title": t, "company": c} for i, (t, c) in enumerate([("Data engineer", "Acme"), ("Engineer", None), ("Cook", "Acme"), ("Data scientist", "Bolt"), (None, "Bolt")])]
    (tmp_path / "feed.json").write_text(json.dumps({"jobs": jobs}))
    spark.dataSource.register(readers.JobBoard)
    read = lambda where, **o: spark.read.format("jobboard").option("urls", f"file://{tmp_path}/feed.json").options(**o).load().where(where)
    conditions = ["title like 'Data%'", "company = 'Acme' and title like '%oo%'", "company in ('Bolt', 'x')", "company is null", "title like '%engineer' or company = 'Bolt'", "company is not null and length(title) > 5", "external_id = '3'"]
    want = [sorted(r["external_id"] for r in read(c).collect()) for c in conditions]
    assert want == [["0", "3"], ["2"], ["3", "4"], ["1"], ["0", "3", "4"], ["0", "3"], ["3"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [sorted(r["external_id"] for r in read(c, pushdown="true").collect()) for c in conditions] == want
        plan = read("company = 'Acme'", pushdown="true")._jdf.queryExecution().executedPlan().toString()
        assert not any(line.lstrip("+-:* ()0123456789").startswith("Filter") for line in plan.splitlines())
        assert [r["external_id"] for r in read("company = 'Bolt'", limit="3", pushdown="true").collect()] == []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def mail(number, subject, sender="Ann <ann@x.org>"):
    return f"Message-ID: <m{number}@x>\r\nSubject: {subject}\r\nFrom: {sender}\r\nDate: Tue, 2 Jan 2024 03:04:05 +0000\r\n\r\nBody {number}\r\n"


def test_mail_headers(spark, tmp_path):
    """Folded headers, encoded words of both forms and of two charsets, blanks between them, unknown charsets, and codes that are none."""
    b = "=?utf-8?B?" + base64.b64encode("Größe – 100%".encode()).decode() + "?="
    q = "=?UTF-8?Q?" + quopri.encodestring("Müller_50%".encode(), header=True).decode().replace("_", "=5F").replace(" ", "_") + "?="
    subjects = {1: b, 2: f"Re: {q} and more", 3: "=?utf-8?Q?Caf=C3=A9?=\r\n =?utf-8?Q?_au_lait?= now", 4: "long\r\n\tsubject here", 5: "=?iso-8859-1?q?Jos=E9?=", 6: "=?x-none?Q?a?= ok", 7: "50% off = ?=", 8: "=?utf-8?B?!!!?="}
    for k, s in subjects.items():
        (tmp_path / f"{k}.eml").write_text(mail(k, s), newline="")
    got = {r["message_id"]: r["subject"] for r in readers.landed_mail(spark, f"file://{tmp_path}").collect()}
    assert got == {
        "m1@x": "Größe – 100%", "m2@x": "Re: Müller_50% and more", "m3@x": "Café au lait now", "m4@x": "long subject here", "m5@x": "José", "m6@x": "=?x-none?Q?a?= ok", "m7@x": "50% off = ?=", "m8@x": "=?utf-8?B?!!!?=",
    }


def test_mail_stream(spark, tmp_path):
    """Every file once over three runs, a restart without new files included."""
    (tmp_path / "in").mkdir()
    seen = []

    def run():
        q = readers.landed_mail(spark, f"file://{tmp_path}/in", stream=True).writeStream.foreachBatch(lambda df, i: seen.append(sorted(r["message_id"] for r in df.collect())))
        q.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    for numbers in ((1, 2), (), (3,)):
        for k in numbers:
            (tmp_path / "in" / f"{k}.eml").write_text(mail(k, "s"), newline="")
        run()
    assert [x for x in seen if x] == [["m1@x", "m2@x"], ["m3@x"]]
