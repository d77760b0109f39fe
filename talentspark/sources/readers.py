"""Sources: profile exports (CSV), text and HTML documents, dictionaries, landed job feeds, a job-board data source."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from ..functions import text as T

JOB_SCHEMA = "source string, external_id string, title string, company string, location string, url string, text string"


def profile_export(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One CSV of a professional-network export: quoted fields, doubled quotes, header names as given."""
    return spark.read.csv(f"{folder}/{table}.csv", header=True, quote='"', escape='"', multiLine=True)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Positions with month dates; an empty end is the current position."""
    month = lambda c: F.to_date(F.concat(F.lit("01 "), F.trim(c)), "dd MMM yyyy")
    p = profile_export(spark, folder, "Positions")
    end = F.when(F.trim("Finished On") != "", month(F.col("Finished On")))
    return p.select(F.col("Company Name").alias("company"), F.col("Title").alias("title"), F.col("Description").alias("text"), month(F.col("Started On")).alias("start_date"), end.alias("end_date"), end.isNull().alias("is_current"))


def endorsed_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Skills of an export with the number of endorsements received."""
    skills = profile_export(spark, folder, "Skills").select(F.trim("Name").alias("skill"))
    votes = profile_export(spark, folder, "Endorsement_Received_Info").groupBy(F.trim("Skill Name").alias("skill")).agg(F.count("*").alias("n"))
    return skills.join(votes, "skill", "left").select("skill", F.coalesce("n", F.lit(0)).alias("endorsements"))


def education(spark: SparkSession, folder: str) -> DataFrame:
    """Schools of an export with degree, years and notes."""
    year = lambda c: F.regexp_extract(F.col(c), "([0-9]{4})", 1).try_cast("int")
    return profile_export(spark, folder, "Education").select(F.col("School Name").alias("institution"), F.col("Degree Name").alias("degree"), year("Start Date").alias("start_year"), year("End Date").alias("end_year"), F.col("Notes").alias("notes"))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """The one profile row of an export."""
    p = profile_export(spark, folder, "Profile")
    return p.select(F.concat_ws(" ", "First Name", "Last Name").alias("name"), F.col("Headline").alias("headline"), F.col("Summary").alias("summary"), F.col("Geo Location").alias("location"))


def stored_records(spark: SparkSession, path: str, schema: str, order: str | None = None) -> DataFrame:
    """Keyed JSON records (id, data) landed as Parquet, decoded; records that are no JSON of the schema have null fields."""
    rows = spark.read.parquet(path).select("id", F.from_json("data", schema).alias("d")).select("id", "d.*")
    return rows.orderBy(order, "id") if order else rows


def json_state(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One list of a whole-state JSON document, a row an item."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("x")).select("x.*")


def migrate_state(spark: SparkSession, path: str, fields: list[str], out: str) -> None:
    """One-shot move of the lists of a state document into keyed record tables (id, data), one a list."""
    for f in fields:
        items = json_state(spark, path, f)
        items.select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(*items.columns)).alias("data")).write.mode("overwrite").parquet(f"{out}/{f}")


def chosen_parse(parses: DataFrame, least: float = 0.5) -> DataFrame:
    """Per file of parses(name, parser, priority, text, confidence): the first parser by priority of confidence ``least`` or more."""
    good = parses.where(F.col("confidence") >= least)
    return good.groupBy("name").agg(F.min_by(F.struct("parser", "text", "confidence"), F.struct("priority", "parser")).alias("b")).select("name", "b.*")


def is_profile_export(names: Column) -> Column:
    """Whether the file names of an archive (an array) are those of a profile export."""
    low = F.transform(names, lambda x: F.lower(F.element_at(F.split(x, "/"), -1)))
    return F.array_contains(low, "profile.csv") & (F.array_contains(low, "positions.csv") | F.array_contains(low, "skills.csv"))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """Landed repository JSON, a line each: name, languages as (language, bytes, share), topics, size, stars, pushed; forks and archives left out."""
    r = spark.read.schema("name string, fork boolean, archived boolean, size long, stargazers_count long, pushed_at string, topics array<string>, languages map<string, long>").json(path)
    r = r.where(~F.coalesce("fork", F.lit(False)) & ~F.coalesce("archived", F.lit(False)) & (F.col("size") >= 5))
    total = F.aggregate(F.map_values("languages"), F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.transform(F.map_entries("languages"), lambda e: F.struct(F.lower(e["key"]).alias("language"), e["value"].alias("bytes"), F.try_divide(e["value"], total).alias("share")))
    return r.select("name", F.filter(shares, lambda x: x["share"] >= 0.05).alias("languages"), "topics", F.col("size").alias("size_kb"), F.col("stargazers_count").alias("stars"), F.to_date(F.substring("pushed_at", 1, 10)).alias("pushed"))


def role_skills(spark: SparkSession, path: str) -> DataFrame:
    """``role|skill`` lines (# comments) as (role, skill)."""
    x = spark.read.text(path).where("value like '%|%' and value not like '#%'")
    return x.select(F.trim(F.substring_index("value", "|", 1)).alias("role"), F.lower(F.trim(F.substring_index("value", "|", -1))).alias("skill")).distinct()


def level_terms(spark: SparkSession, path: str) -> DataFrame:
    """``level:country:name`` lines (# comments) as (level, country, name)."""
    x = spark.read.text(path).where("value not like '#%'").select(F.split("value", ":", 3).alias("p")).where(F.size("p") == 3)
    return x.select(F.trim(F.get("p", 0)).alias("level"), F.lower(F.trim(F.get("p", 1))).alias("country"), F.lower(F.trim(F.get("p", 2))).alias("name")).distinct()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One lower-cased word a line (# comments)."""
    return spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(F.lower(F.trim("value")).alias("word")).distinct()


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: name, text, and the confidence of a plain-text parse (0.65 from two capital headings on, else 0.4)."""
    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    heads = F.size(F.filter(F.split("text", "\n"), lambda x: (F.length(F.trim(x)).between(2, 60)) & (F.upper(x) == x) & x.rlike("[A-Z]")))
    return d.withColumn("confidence", F.when(heads >= 2, 0.65).otherwise(0.4))


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed .txt, .md and .html files as (name, kind, text, confidence); other kinds are left out.

    Plain text has the confidence of ``text_documents``, Markdown 0.75 with two headings or more, else
    0.5; HTML is stripped and has 0.6.
    """
    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    d = d.withColumn("kind", F.lower(F.regexp_extract("name", r"\.([A-Za-z]+)$", 1)))
    d = d.withColumn("kind", F.when(F.col("kind") == "htm", "html").otherwise(F.col("kind"))).where(F.col("kind").isin("txt", "md", "html"))
    marks = F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("#")))
    heads = F.size(F.filter(F.split("text", "\n"), lambda x: (F.length(F.trim(x)).between(2, 60)) & (F.upper(x) == x) & x.rlike("[A-Z]")))
    sure = F.when(F.col("kind") == "html", 0.6).when(F.col("kind") == "md", F.when(marks >= 2, 0.75).otherwise(0.5)).otherwise(F.when(heads >= 2, 0.65).otherwise(0.4))
    return d.select("name", "kind", F.when(F.col("kind") == "html", T.strip_html(F.col("text"))).otherwise(F.col("text")).alias("text"), sure.alias("confidence"))


def decoded_words(header: Column) -> Column:
    """A mail header with its encoded words (=?charset?B?..?= and =?charset?Q?..?=) in plain; unknown charsets stay as they are.

    Blanks between two encoded words belong to the code and go.
    """
    word = r"=\?([A-Za-z0-9_-]+)\?([BbQq])\?([^?\s]*)\?="
    joined = F.regexp_replace(header, r"(\?=)\s+(?==\?)", "$1")

    def plain(x: Column) -> Column:
        charset, form, code = (F.regexp_extract(x, word, i) for i in (1, 2, 3))
        hexed = F.regexp_replace(F.translate(F.replace(code, F.lit("%"), F.lit("=25")), "_", " "), "=([0-9A-Fa-f]{2})", "%$1")
        # Every other character as itself, each %XX as its byte.
        parts = F.regexp_extract_all(hexed, F.lit("%[0-9A-Fa-f]{2}|[^%]|%"), 0)
        quoted = F.unhex(F.concat_ws("", F.transform(parts, lambda c: F.when(c.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(c, 2, 2)).otherwise(F.hex(F.encode(c, "UTF-8"))))))
        raw = F.when(F.upper(form) == "B", F.try_to_binary(code, F.lit("base64"))).otherwise(quoted)
        known = F.upper(charset)
        text = F.when(known.isin("UTF-8", "US-ASCII"), F.decode(raw, "UTF-8")).when(known.isin("ISO-8859-1", "LATIN1"), F.decode(raw, "ISO-8859-1"))
        return F.coalesce(text, x)

    return F.aggregate(F.array_distinct(F.regexp_extract_all(joined, F.lit(word), 0)), joined, lambda a, x: F.replace(a, x, plain(x)))


def landed_mail(spark: SparkSession, path: str, preview: int = 500, stream: bool = False) -> DataFrame:
    """Landed .eml files as (message_id, subject, sender, date, body_preview); a file without a message id is left out.

    Folded headers are joined and encoded words are decoded.  As a ``stream`` each file is read once, restarts included: the
    checkpoint knows the files that were read.
    """
    reader = spark.readStream if stream else spark.read
    d = reader.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("m"))
    top = F.regexp_replace(F.substring_index("m", "\n\n", 1), "\n[ \t]+", " ")
    head = lambda name: F.trim(decoded_words(F.regexp_extract(top, f"(?im)^{name}:[ ]*(.*)$", 1)))
    body = F.when(F.col("m").contains("\n\n"), F.expr("substring(m, instr(m, '\n\n') + 2)")).otherwise("")
    sender = F.coalesce(F.when(head("From").contains("<"), F.regexp_extract(head("From"), "<([^>]*)>", 1)), head("From"))
    date = F.try_to_timestamp(F.regexp_extract(head("Date"), r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    out = d.select(F.translate(head("Message-ID"), "<>", "").alias("message_id"), head("Subject").alias("subject"), sender.alias("sender"), date.alias("date"), F.substring(body, 1, preview).alias("body_preview"))
    return out.where("message_id <> ''")


def job_rss(spark: SparkSession, path: str, keyword: str = "", limit: int = 0) -> DataFrame:
    """Landed RSS feeds as rows of the job boards' schema; an optional keyword in title or description, and limit."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item>(.*?)</item>"), 1)).alias("i"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("i", f"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    out = items.select(F.lit("rss").alias("source"), tag("guid").alias("external_id"), tag("title").alias("title"), tag("company").alias("company"), tag("location").alias("location"), tag("link").alias("url"), T.strip_html(tag("description")).alias("text"))
    if keyword:
        out = out.where(F.lower(F.concat_ws(" ", "title", "text")).contains(keyword.lower()))
    return out.limit(limit) if limit else out


def rules_from_json(spark: SparkSession, path: str) -> dict:
    """A ruleset {label: [[mark, points], ..]} kept as one JSON document, for ``weighted_pattern`` and ``first_match``."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    return {label: tuple((str(m), int(n)) for m, n in marks) for label, marks in json.loads(text).items()}


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``canonical: alias, alias`` lines (# comments) as (alias, canonical), each canonical being its own alias."""
    x = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    x = x.select(F.lower(F.trim(F.substring_index("value", ":", 1))).alias("canonical"), F.split(F.concat_ws(",", F.substring_index("value", ":", 1), F.substring_index("value", ":", -1)), ",").alias("a"))
    return x.select(F.explode("a").alias("alias"), "canonical").select(F.lower(F.trim("alias")).alias("alias"), "canonical").where("alias <> ''").distinct()


def job_pages(pages: DataFrame, manual_hosts: tuple[str, ...] = ()) -> DataFrame:
    """Strategy ladder over landed pages(url, html): structured data, then page text of over 200 characters; manual hosts are left out."""
    x = pages.withColumn("host", T.url_host(F.col("url"))).where(~F.coalesce(F.col("host").isin(list(manual_hosts)), F.lit(False)))
    j, t = T.json_ld_posting(F.col("html")), T.strip_html(F.col("html"))
    title = F.coalesce(j["title"], F.when(T.page_title(F.col("html")) != "", T.page_title(F.col("html"))))
    return x.select("url", "host", title.alias("title"), j["company"].alias("company"), j["location"].alias("location"), j["salary_min"].alias("salary_min"), j["salary_max"].alias("salary_max"), *[j[c].alias(c) for c in ("salary_currency", "is_remote", "employment_type")], F.when(F.length(t) > 200, t).alias("text"))


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


_JOB_COLUMNS = [c.split()[0] for c in JOB_SCHEMA.split(", ")]
_TESTS = (EqualTo, In, IsNotNull, StringContains, StringStartsWith, StringEndsWith)


def _holds(f: Filter, value: str | None) -> bool:
    """Whether a value passes a pushed filter; a missing value passes none."""
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringContains):
        return f.value in value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    return value.endswith(f.value) if isinstance(f, StringEndsWith) else value == f.value


class _JobReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split(",") if u]
        self.board, self.keyword = options.get("board", "feed"), options.get("keyword", "").lower()
        self.limit = int(options.get("limit", "0"))
        self.wanted: list[Filter] = []

    def partitions(self):
        return [_Page(u) for u in self.urls]

    def read(self, partition) -> Iterator[tuple]:
        with urlopen(partition.url) as f:
            rows = json.load(f)
        rows = rows.get("jobs", rows.get("results", [])) if isinstance(rows, dict) else rows
        kept = (r for r in rows if not self.keyword or self.keyword in json.dumps(r, ensure_ascii=False).lower())
        for n, r in enumerate(kept):
            if self.limit and n >= self.limit:
                return
            row = (self.board, str(r.get("id", "")), r.get("title"), r.get("company"), r.get("location"), r.get("url"), r.get("description"))
            if all(_holds(f, row[_JOB_COLUMNS.index(f.attribute[0])]) for f in self.wanted):
                yield row


class _PushedJobReader(_JobReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on plain columns are tested where a page is read; the others are left to Spark.  With a limit none is taken, as it would count other rows."""
        for f in filters:
            if not self.limit and isinstance(f, _TESTS) and len(f.attribute) == 1:
                self.wanted.append(f)
            else:
                yield f


class JobBoard(DataSource):
    """A job board as a Spark data source: options urls (comma-separated pages), board, keyword, limit a page.

    With the option ``pushdown`` filters on its columns are taken over; ``spark.sql.python.filterPushdown.enabled`` has to be true then.
    """

    @classmethod
    def name(cls) -> str:
        return "jobboard"

    def schema(self) -> str:
        return JOB_SCHEMA

    def reader(self, schema):
        return (_PushedJobReader if self.options.get("pushdown", "false").lower() == "true" else _JobReader)(self.options)
