"""Lines, boxes, lists and lookups: what turns loose text and records into rows that other operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import digest, mentioned


def distinct_ignoring_case(items: Column) -> Column:
    """An array's items with the later of those equal without case left out, in order."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def union_ignoring_case(a: Column, b: Column) -> Column:
    return distinct_ignoring_case(F.concat(a, b))


def chunks(rows: DataFrame, key: str, order: str, size: int = 5) -> DataFrame:
    """Rows with the number of their chunk of ``size`` rows a key, in order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def blocks_of_lines(docs: DataFrame, id_col: str, blanks: int = 1) -> DataFrame:
    """(id, pos, line, block): lines with text, numbered by blocks that ``blanks`` or more empty lines end."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    full = lines.withColumn("full", F.trim("line") != "").where("full").drop("full")
    w = Window.partitionBy(id_col).orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(w) - 1
    return full.withColumn("new", F.coalesce(gap >= blanks, F.lit(False)).cast("int")).withColumn("block", F.sum("new").over(w).cast("int")).drop("new")


def merged_lines(lines: DataFrame, id_col: str, opens: Column) -> DataFrame:
    """Lines (id, pos, line) that open an entry, each with the next line where that opens none: (id, pos, line, next)."""
    w = Window.partitionBy(id_col).orderBy("pos")
    x = lines.withColumn("opens", F.coalesce(opens, F.lit(False)))
    follow = F.when(~F.lead("opens").over(w), F.lead("line").over(w))
    return x.withColumn("next", follow).where("opens").drop("opens")


def lines_from_boxes(boxes: DataFrame, bucket: float = 3.0, wide: float = 40.0, large: float = 1.25) -> DataFrame:
    """Word boxes(doc, page, x, y, width, size, text) as lines (doc, page, row, column, text, heading).

    Words whose y falls in one bucket are a row; a gap of more than ``wide`` parts it into columns; a
    line set in ``large`` times the document's median size, or in capitals, is a heading.
    """
    b = boxes.withColumn("row", F.floor(F.col("y") / bucket).cast("int"))
    w = Window.partitionBy("doc", "page", "row").orderBy("x", "text")
    gap = F.coalesce(F.col("x") - F.lag(F.col("x") + F.col("width")).over(w) > wide, F.lit(False)).cast("int")
    b = b.withColumn("gap", gap).withColumn("column", F.sum("gap").over(w).cast("int"))
    median = boxes.groupBy("doc").agg(F.percentile("size", 0.5).alias("median"))
    words = F.array_sort(F.collect_list(F.struct("x", "text")))
    lines = b.groupBy("doc", "page", "row", "column").agg(words.alias("words"), F.max("size").alias("size"))
    lines = lines.join(median, "doc").withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " "))
    capitals = (F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{L}")
    return lines.select("doc", "page", "row", "column", "text", ((F.col("size") >= large * F.col("median")) | capitals).alias("heading"))


def column_edges(boxes: DataFrame, bucket: float = 3.0, wide: float = 30.0, least_words: int = 10, least_width: float = 200.0, share: float = 0.3) -> DataFrame:
    """(doc, page, edge): where the right one of two columns begins, for pages of boxes(doc, page, x, y, width, ..) that have two.

    Gaps of more than ``wide`` inside a row vote with their middle for a stretch of 10; the stretch with most votes, the left of
    equals, is the gap of the columns if it holds at least ``share`` of the page's rows and there are three gaps in all.
    """
    b = boxes.withColumn("row", F.bround(F.col("y") / bucket))
    w = Window.partitionBy("doc", "page", "row").orderBy("x", "width")
    before = F.lag(F.col("x") + F.col("width")).over(w)
    b = b.withColumn("middle", F.when(F.col("x") - before > wide, (F.col("x") + before) / 2))
    pages = b.groupBy("doc", "page").agg(F.count("*").alias("words"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("across"), F.countDistinct("row").alias("rows"), F.count("middle").alias("gaps"))
    pages = pages.where((F.col("words") >= least_words) & (F.col("across") >= least_width) & (F.col("gaps") >= 3))
    votes = b.where("middle is not null").groupBy("doc", "page", F.bround(F.col("middle") / 10).alias("stretch")).agg(F.count("*").alias("votes"), F.avg("middle").alias("edge"))
    best = votes.groupBy("doc", "page").agg(F.min_by(F.struct("votes", "edge"), F.struct(-F.col("votes"), "stretch")).alias("best"))
    return pages.join(best, ["doc", "page"]).where(F.col("best.votes") >= share * F.col("rows")).select("doc", "page", "best.edge")


def reading_order(boxes: DataFrame, line: float = 2.0, large: float = 1.25, title: float = 1.5) -> DataFrame:
    """Word boxes(doc, page, x, y, width, size, text), y from the top, as lines (doc, page, column, line, text, size, level).

    Lines are read by page, then column, then line.  A line set in ``large`` times the median size of the document's lines is a heading of
    level 2, in ``title`` times of level 1; a line of under 50 characters in capitals is one of level 2; others have none.
    """
    b = boxes.join(column_edges(boxes), ["doc", "page"], "left")
    b = b.withColumn("column", F.coalesce(F.col("x") >= F.col("edge"), F.lit(False)).cast("int")).withColumn("line", F.bround(F.col("y") / line).cast("int"))
    words = F.array_sort(F.collect_list(F.struct("x", "text")))
    letters = F.greatest(F.length("text"), F.lit(1))
    lines = b.groupBy("doc", "page", "column", "line").agg(words.alias("words"), (F.sum(F.col("size") * letters) / F.sum(letters)).alias("size"))
    lines = lines.withColumn("text", F.trim(F.array_join(F.transform("words", lambda x: x["text"]), " "))).where("text <> ''")
    lines = lines.join(lines.groupBy("doc").agg(F.percentile("size", 0.5).alias("median")), "doc")
    capitals = (F.length("text") < 50) & (F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{L}")
    level = F.when(F.round(F.col("size") / F.col("median"), 9) >= title, 1).when((F.round(F.col("size") / F.col("median"), 9) >= large) | capitals, 2)
    return lines.select("doc", "page", "column", "line", "text", "size", level.alias("level"))


def entity_lookup(docs: DataFrame, id_col: str, names: DataFrame) -> DataFrame:
    """(id, name, kind) of names(name, kind) found in texts: companies between signs that are no letter or digit, others anywhere."""
    texts = docs.select(id_col, F.lower(F.coalesce("text", F.lit(""))).alias("low")).withColumn("digest", digest(F.col("low")))
    known = names.select(F.lower("name").alias("phrase"), "name", "kind")
    met = mentioned(names.select("name"), texts.select("low")).join(known, "phrase").groupBy("digest").agg(F.collect_set(F.struct("name", "kind", "phrase")).alias("found"))
    signs = F.concat(F.lit(" "), F.regexp_replace("low", r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    asked = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(x["phrase"], r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    hits = texts.join(met, "digest").withColumn("signs", signs).withColumn("hits", F.filter("found", lambda x: (x["kind"] != "company") | F.col("signs").contains(asked(x))))
    return hits.select(id_col, F.explode("hits").alias("h")).select(id_col, "h.name", "h.kind").distinct()


def categorised(skills: DataFrame, taxonomy: DataFrame, default: str = "other") -> DataFrame:
    """skills(skill, ..) with the category of taxonomy(skill, category) that names them; of several the first by name."""
    t = taxonomy.groupBy(F.lower("skill").alias("_low")).agg(F.min("category").alias("category"))
    return skills.join(t, F.lower("skill") == F.col("_low"), "left").withColumn("category", F.coalesce("category", F.lit(default))).drop("_low")


def canonical_language(name: Column, names: dict[str, str]) -> Column:
    """A language's canonical name by a fixed map, else itself in lower case."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(name)), F.lower(name))


def template_scores(pairs: DataFrame) -> DataFrame:
    """pairs(.., same_hash, same_name, same_margins, similarity) with the score of a template match.

    Equal hashes score 1, templates of one name 0.97, others their similarity plus 0.05 for equal
    margins; 0.8 matches, 0.95 is the same template.
    """
    plain = F.least(F.lit(1.0), F.col("similarity") + F.when(F.col("same_margins"), 0.05).otherwise(0.0))
    score = F.when(F.col("same_hash"), 1.0).when(F.col("same_name"), 0.97).otherwise(plain)
    level = F.when(F.round(score, 9) >= 0.95, "same").when(F.round(score, 9) >= 0.8, "match")
    return pairs.withColumn("score", score).withColumn("level", level)


def domain_points(entities: DataFrame, k: int = 3, default: str = "general") -> DataFrame:
    """(entity, domain, share, rank) from entities(entity, domain, skills, titles, texts): 3, 5 and 1 points a hit, shares of the largest.

    The ``k`` best domains of an entity; one without a point is ``default`` at 0.5.
    """
    x = entities.withColumn("points", 3 * F.coalesce("skills", F.lit(0)) + 5 * F.coalesce("titles", F.lit(0)) + F.coalesce("texts", F.lit(0)))
    x = x.groupBy("entity").agg(F.max("points").alias("most")).join(x, "entity")
    w = Window.partitionBy("entity").orderBy(F.desc("points"), "domain")
    some = x.where("points > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("entity", "domain", (F.col("points") / F.col("most")).alias("share"), "rank")
    none = x.where("most = 0").select("entity").distinct().select("entity", F.lit(default).alias("domain"), F.lit(0.5).alias("share"), F.lit(1).alias("rank"))
    return some.unionByName(none)
