"""Matching ledgers against weighted requirements: tiers, coverage, ranking, career gaps, mails.

Strings meet on distinct vocabularies first (``contained``, ``mentioned``), then hash joins
bring the rows together.  Entities that match the same terms are one class, specs that ask
for the same are one class, and scores belong to pairs of classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import written
from . import vector_index

SUBSTRING, EQUIVALENT, FALLBACK = 0.85, 0.82, 0.65
#: The tier of matches by vectors alone.
SEMANTIC = 4
#: Strings of up to this many characters are looked up as they are, longer ones by a part of this length.
LONG = 32
#: Words that say nothing about a requirement (fixed values).
STOP_WORDS = ("with", "and", "the", "for", "using", "experience", "knowledge", "skills", "ability", "years")


def _strings(df: DataFrame, name: str = "s") -> DataFrame:
    return df.select(F.lower(df.columns[0]).alias(name)).where(F.col(name) != "").distinct()


def _grams(c: Column, sizes: Column) -> Column:
    """Distinct character grams of the sizes that fit into the string."""
    runs = F.transform(F.filter(sizes, lambda n: n <= F.length(c)), lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    return F.array_distinct(F.flatten(runs))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): every lower-cased string of ``parts`` inside one of ``wholes`` (one column each), distinct.

    Wholes give all their grams of the lengths that parts have, so a part meets just the wholes it is in.  A part of more
    than ``LONG`` characters meets those that have its rarest gram of that length; ``contains`` then decides.
    """
    p, w = _strings(parts, "part"), _strings(wholes, "whole")
    short, long = p.where(F.length("part") <= LONG), p.where(F.length("part") > LONG)
    sizes = short.agg(F.collect_set(F.length("part")).alias("sizes"))
    grams = w.crossJoin(F.broadcast(sizes)).select("whole", F.explode(_grams(F.col("whole"), F.col("sizes"))).alias("part"))
    found = grams.join(short, "part").select("part", "whole")
    grams = w.where(F.length("whole") > LONG).select("whole", F.explode(_grams(F.col("whole"), F.array(F.lit(LONG)))).alias("g"))
    keys = long.select("part", F.explode(_grams(F.col("part"), F.array(F.lit(LONG)))).alias("g"))
    count = grams.join(keys.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("n"))
    keys = keys.join(count, "g").groupBy("part").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    return found.unionByName(keys.join(grams, "g").where(F.col("whole").contains(F.col("part"))).select("part", "whole"))


def digest(text: Column) -> Column:
    """What stands for a text in joins: the MD5 of its lower-cased form."""
    return F.md5(F.lower(text))


def mentioned(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(phrase, digest): every lower-cased phrase and the digest of every text it is inside, distinct.

    A phrase's longest word meets the words of the different texts first; only digests travel until ``contains`` decides.
    """
    p = _strings(phrases, "phrase").withColumn("key", F.element_at(F.array_sort(F.transform(F.split("phrase", " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"])
    t = _strings(texts, "text").select(digest(F.col("text")).alias("digest"), "text")
    words = t.select("digest", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    hits = contained(p.select("key"), words.select("word"))
    met = p.join(hits, F.col("key") == F.col("part")).select("phrase", F.col("whole").alias("word")).join(words, "word").select("phrase", "digest").distinct()
    single = met.where(~F.col("phrase").contains(" "))
    several = met.where(F.col("phrase").contains(" ")).groupBy("digest").agg(F.collect_set("phrase").alias("phrases")).join(t, "digest")
    several = several.select(F.explode(F.filter("phrases", lambda x: F.col("text").contains(x))).alias("phrase"), "digest")
    return single.unionByName(several)


def equivalent(skills: DataFrame, terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(skill, term) of one canonical name by synonyms(alias, canonical); a canonical name is its own alias."""
    c = synonyms.select(F.lower("alias").alias("alias"), F.lower("canonical").alias("canonical"))
    c = c.unionByName(c.select(F.col("canonical").alias("alias"), "canonical")).distinct()
    left = _strings(skills, "skill").join(c, F.col("skill") == F.col("alias")).select("skill", "canonical")
    return left.join(_strings(terms, "term").join(c, F.col("term") == F.col("alias")).select("term", "canonical"), "canonical").select("skill", "term")


def vocabulary_matches(skills: DataFrame, terms: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(skill, term, tier) of lower-cased distinct strings: 1 if either contains the other, else 2 if they are synonyms."""
    found = contained(skills, terms).select(F.col("part").alias("skill"), F.col("whole").alias("term"))
    found = found.unionByName(contained(terms, skills).select(F.col("whole").alias("skill"), F.col("part").alias("term"))).withColumn("tier", F.lit(1))
    if synonyms is not None:
        found = found.unionByName(equivalent(skills, terms, synonyms).withColumn("tier", F.lit(2)))
    return found.groupBy("skill", "term").agg(F.min("tier").alias("tier"))


def _holding(terms: DataFrame, texts: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, digest): every lower-cased term and the digest of every text that holds two of its words of over three letters, or the only one."""
    t = _strings(terms, "term")
    w = t.withColumn("words", F.filter(F.split("term", " "), lambda x: (F.length(x) > 3) & ~x.isin(*stop_words)))
    w = w.select("term", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    words = _strings(texts.select("text"), "text").select(digest(F.col("text")).alias("digest"), F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    hits = contained(w.select("word"), words.select("token"))
    hits = words.join(hits, F.col("token") == F.col("whole")).select("digest", F.col("part").alias("word")).distinct()
    good = w.join(hits, "word").groupBy("term", "n", "digest").agg(F.count("*").alias("hits")).where((F.col("hits") >= 2) | (F.col("n") == 1))
    return good.select("term", "digest")


def _achieved(texts: DataFrame, held: DataFrame) -> DataFrame:
    """(entity, term) of each text by held(term, digest), repeats included.

    What is held is written, so its size is known: where few different texts hold a term, the texts are not shuffled for it.
    """
    return texts.select("entity", digest(F.col("text")).alias("digest")).join(written(held, "held"), "digest").select("entity", "term")


def from_achievements(terms: DataFrame, texts: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(entity, term) whose texts(entity, text) hold two of the term's words of over three letters, or the only one."""
    return _achieved(texts, _holding(terms, texts, stop_words)).distinct()


def near_terms(skills: DataFrame, terms: DataFrame, model: Callable[[Column], Column], threshold: float = 0.58) -> DataFrame:
    """(skill, term, cosine) of lower-cased distinct strings (one column each) whose unit vectors by ``model`` reach the threshold.

    Each string goes through the model once; blocks of terms meet the skills in one pass each, see ``vector_index``.
    """
    number = F.monotonically_increasing_id() * 2
    s = written(_strings(skills, "skill").select("skill", model(F.col("skill")).alias("v"), number.alias("id")), "skills")
    t = written(_strings(terms, "term").select("term", model(F.col("term")).alias("q"), (number + 1).alias("query_id")), "terms")
    found = vector_index.reaching(t.select("query_id", "q"), s.select("id", "v"), threshold)
    return found.join(s.select("id", "skill"), "id").join(t.select("query_id", "term"), "query_id").select("skill", "term", F.col("similarity").alias("cosine"))


def best_entries(ledger: DataFrame, requirements: DataFrame, synonyms: DataFrame | None = None, texts: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Best ledger entry a (entity, term): the strongest entry that contains the term, is contained in it or is its synonym.

    Case is ignored; ties go by name.  Terms without such an entry take the one of highest cosine by
    near(skill, term, cosine), as ``near_terms`` gives them, and have that as their similarity.  Terms left then fall back to
    ``from_achievements``, with the strength of the entity's strongest entry.  Terms are matched once however many specs ask for them.
    """
    terms = requirements.select("term").distinct().withColumn("low", F.lower("term"))
    pairs = vocabulary_matches(ledger.select("skill"), terms.select("term"), synonyms).select(F.col("skill").alias("low_skill"), F.col("term").alias("low"), "tier")
    pairs = pairs.join(terms, "low").select("low_skill", "term", "tier")
    pairs = pairs.withColumn("cosine", F.lit(None).cast("double"))
    if near is not None:
        pairs = pairs.unionByName(near.withColumnRenamed("term", "low").join(terms, "low").select(F.col("skill").alias("low_skill"), "term", F.lit(SEMANTIC).alias("tier"), "cosine"))
    # Written, so its size is known: the ledger is not shuffled for a small vocabulary.
    rows = ledger.select("entity", "skill", "strength", F.lower("skill").alias("low_skill")).join(written(pairs, "pairs"), "low_skill")
    # A cosine counts only where no entry does, a text only where neither does.
    choice = lambda late, s, *rest: F.struct(late.alias("late"), s.alias("s"), *rest).alias("b")
    strongest_first = -F.coalesce(F.round("cosine", 9), F.round("strength", 6))
    rows = rows.select("entity", "term", choice(F.when(F.col("tier") == SEMANTIC, 1).otherwise(0), strongest_first, "skill", "tier", "strength", "cosine"))
    if texts is not None:
        none = F.lit(None).cast("double")
        held = _holding(terms.select("term"), texts).withColumnRenamed("term", "low").join(terms, "low").select("term", "digest")
        rows = rows.unionByName(_achieved(texts, held).select("entity", "term", choice(F.lit(2), none, F.lit("(evidence)").alias("skill"), F.lit(3).alias("tier"), none.alias("strength"), none.alias("cosine"))))
    best = rows.groupBy("entity", "term").agg(F.min("b").alias("b")).select("entity", "term", "b.*").drop("s")
    if texts is not None:
        # Only what rests on a text in the end asks for the strongest entry.
        best = written(best, "best")
        strongest = ledger.groupBy("entity").agg(F.max("strength").alias("strength"))
        resting = best.where("late = 2").drop("strength").join(strongest, "entity")
        best = best.where("late < 2").unionByName(resting)
    tier = F.col("tier")
    similarity = F.when(tier == 1, SUBSTRING).when(tier == 2, EQUIVALENT).when(tier == SEMANTIC, F.col("cosine")).otherwise(FALLBACK)
    return best.select("entity", "term", "skill", "strength", similarity.alias("similarity"))


def tiered_match(best: DataFrame, requirements: DataFrame) -> DataFrame:
    """``best_entries`` as one row a (entity, spec, term): as many rows as entities times specs may have."""
    return requirements.select("spec", "term", "importance").join(best, "term").select("entity", "spec", "term", "importance", "skill", "strength", "similarity")


def spec_classes(requirements: DataFrame) -> DataFrame:
    """(spec, terms, terms_id, spec_class, n_specs, needs): specs that ask for the same terms share ``terms_id``, those that
    weigh them the same too share ``spec_class`` (each the smallest spec)."""
    s = requirements.groupBy("spec").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.array_sort(F.collect_set(F.struct("term", "importance"))).alias("needs"))
    same_terms = s.groupBy("terms").agg(F.min("spec").alias("terms_id"))
    same_needs = s.groupBy("needs").agg(F.min("spec").alias("spec_class"), F.count("*").alias("n_specs"))
    return s.join(same_terms, "terms").join(same_needs, "needs").select("spec", "terms", "terms_id", "spec_class", "n_specs", "needs")


def entity_sets(best: DataFrame, specs: DataFrame) -> DataFrame:
    """(entity, terms_id, have, mean_strength): what each entity has of each set of terms, where it has any."""
    asked = specs.where(F.col("spec") == F.col("terms_id")).select("terms_id", F.explode("terms").alias("term"))
    return best.join(asked, "term").groupBy("entity", "terms_id").agg(F.array_sort(F.collect_set("term")).alias("have"), F.avg("strength").alias("mean_strength"))


def coverage(sets: DataFrame, specs: DataFrame) -> DataFrame:
    """Per pair of classes with any match: required and preferred coverage, fit, mean strength, and the members of both."""
    e = sets.groupBy("terms_id", "have").agg(F.min("entity").alias("entity_class"), F.count("*").alias("n_entities"), F.avg("mean_strength").alias("mean_strength"))
    s = specs.where(F.col("spec") == F.col("spec_class")).select("terms_id", "spec_class", "n_specs", "needs")
    j = e.join(s, "terms_id")
    n = lambda level, got: F.size(F.filter("needs", lambda x: (x["importance"] == level) & (F.array_contains("have", x["term"]) if got else F.lit(True)))).cast("long")
    j = j.select("*", n(0, True).alias("got_required"), n(1, True).alias("got_preferred"), n(0, False).alias("n_required"), n(1, False).alias("n_preferred"), F.size("have").cast("long").alias("matched"))
    req = F.when(F.col("n_required") == 0, 1.0).otherwise(F.col("got_required") / F.col("n_required"))
    pref = F.when(F.col("n_preferred") == 0, 0.0).otherwise(F.col("got_preferred") / F.col("n_preferred"))
    return j.withColumn("required_coverage", req).withColumn("preferred_coverage", pref).withColumn("fit", 0.7 * F.col("required_coverage") + 0.3 * F.col("preferred_coverage"))


def members(sets: DataFrame) -> DataFrame:
    """(entity, terms_id, entity_class): the class of each entity, by its smallest member."""
    e = sets.groupBy("terms_id", "have").agg(F.min("entity").alias("entity_class"))
    return sets.join(e, ["terms_id", "have"]).select("entity", "terms_id", "entity_class")


def rank(sets: DataFrame, specs: DataFrame, k: int) -> DataFrame:
    """The k best entities of each spec: (spec, rank, entity, fit, mean_strength).

    Members of a class differ only in mean strength, so its k best are enough for every spec; classes
    behind k entities of better fit are dropped before any member is looked up.
    """
    c = coverage(sets, specs).select("terms_id", "have", "spec_class", "n_entities", F.round("fit", 6).alias("fit"))
    better = F.sum("n_entities").over(Window.partitionBy("spec_class").orderBy(F.desc("fit"))) - F.sum("n_entities").over(Window.partitionBy("spec_class", "fit"))
    c = c.withColumn("better", better).where(F.col("better") < k)
    own = Window.partitionBy("terms_id", "have").orderBy(F.round("mean_strength", 6).desc(), "entity")
    best = sets.withColumn("at", F.row_number().over(own)).where(F.col("at") <= k)
    w = Window.partitionBy("spec_class").orderBy(F.desc("fit"), F.round("mean_strength", 6).desc(), "entity")
    top = best.join(c, ["terms_id", "have"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return specs.select("spec", "spec_class").join(top.select("spec_class", "rank", "entity", "fit", "mean_strength"), "spec_class").drop("spec_class")


def canonical(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """terms(term, ..) with the canonical name of their synonym(alias, canonical), else their own lower-cased form."""
    s = synonyms.select(F.lower("alias").alias("_alias"), F.col("canonical"))
    return terms.join(s, F.lower("term") == F.col("_alias"), "left").withColumn("canonical", F.coalesce("canonical", F.lower("term"))).drop("_alias")


def semantic_match(queries: DataFrame, pool: DataFrame, similarity: Column, threshold: float, keys: list[str], apart: Column | None = None) -> DataFrame:
    """Best candidate of each query above the threshold; a query without one keeps its best similarity.  ``apart`` bars pairs, such as a row with itself."""
    pairs = queries.join(pool, keys)
    pairs = (pairs if apart is None else pairs.where(apart)).withColumn("similarity", similarity)
    best = pairs.groupBy("query_id").agg(F.max_by(F.struct("candidate_id", "similarity"), F.struct(F.round("similarity", 9), -F.col("candidate_id"))).alias("b"))
    best = best.select("query_id", "b.candidate_id", "b.similarity")
    return queries.select("query_id").join(best, "query_id", "left").withColumn("matched", F.coalesce(F.col("similarity") >= threshold, F.lit(False)))


def simple_match(jobs: DataFrame, have: list[str], avoid: list[str], vote_bonus: Column) -> DataFrame:
    """matched / required (0.5 when nothing is required), -0.1 per avoided skill, clamp, +0.05 a vote point, clamp; case is ignored, repeats count."""
    mine, off = [x.lower() for x in have], [x.lower() for x in avoid]
    n = F.size("skills")
    hit = lambda names: F.filter("skills", lambda x: F.lower(x).isin(names))
    base = F.when(n == 0, 0.5).otherwise(F.size(hit(mine)) / n) - 0.1 * F.size(hit(off))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return jobs.withColumn("missing", F.filter("skills", lambda x: ~F.lower(x).isin(mine))).withColumn("score", clamp(clamp(base) + 0.05 * vote_bonus))


def archetypes(skills: DataFrame, roles: DataFrame) -> DataFrame:
    """Share of each role's skills an entity has, best first."""
    size = roles.groupBy("role").agg(F.count("*").alias("total"))
    got = skills.select("entity", "skill").distinct().join(roles, "skill").groupBy("entity", "role").agg(F.count("*").alias("matched"))
    return got.join(size, "role").withColumn("percent", 100 * F.col("matched") / F.col("total"))


#: Stop words of responsibilities (fixed values).
DUTY_STOPS = (
    "about", "above", "after", "also", "among", "being", "between",
    "their", "there", "these", "those", "through", "using", "where",
    "which", "while", "will", "with", "working", "within", "would",
    "experience", "ability", "knowledge", "skills", "strong", "across",
)


def keywords(text: Column, longer_than: int = 4, stop_words: tuple[str, ...] = DUTY_STOPS) -> Column:
    """Distinct lower-cased words of more than ``longer_than`` letters, edge signs and stop words left out."""
    w = F.transform(F.split(F.lower(text), "[ \\n]+"), lambda x: F.btrim(x, F.lit(".,;()")))
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > longer_than) & ~x.isin(*stop_words)))


def keyword_overlap(needs: DataFrame, offers: DataFrame, least: int = 2, longer_than: int = 4) -> DataFrame:
    """Offer holding most keywords of each need (at least ``least``): needs(need, keywords), offers(offer, text).

    A keyword, or it without its plural s, may be any part of the text: keywords meet the
    distinct words of the texts.
    """
    k = needs.select("need", F.size("keywords").alias("n"), F.explode("keywords").alias("k"))
    plural = F.col("k").endswith("s") & (F.length("k") > longer_than)
    forms = k.select("k").distinct().select("k", F.explode(F.array_distinct(F.array("k", F.when(plural, F.expr("left(k, length(k) - 1)")).otherwise(F.col("k"))))).alias("form"))
    words = offers.select("offer", F.explode(F.array_distinct(F.split(F.lower("text"), "[ \\n]+"))).alias("word"))
    hits = contained(forms.select("form"), words.select("word")).join(forms, F.col("part") == F.col("form")).select("k", F.col("whole").alias("word")).distinct()
    offer_has = words.join(hits, "word").select("offer", "k").distinct()
    shared = k.join(offer_has, "k").groupBy("need", "offer").agg(F.count("*").alias("overlap"), F.first("n").alias("n")).where(F.col("overlap") >= least)
    best = shared.groupBy("need").agg(F.max_by(F.struct("offer", "overlap", "n"), F.struct("overlap", -F.col("offer"))).alias("b"))
    return best.select("need", "b.offer", "b.overlap", F.least(F.lit(1.0), F.col("b.overlap") / F.col("b.n")).alias("score"))


def covered_terms(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity, term, seq, text) of the first evidence(entity, seq, text) that holds each term; case is ignored."""
    terms = requirements.select("term").distinct()
    met = mentioned(terms, evidence.select("text")).join(terms, F.col("phrase") == F.lower("term"))
    first = evidence.withColumn("digest", digest(F.col("text"))).join(met.select("term", "digest"), "digest").groupBy("entity", "term").agg(F.min(F.struct("seq", "text")).alias("b"))
    return first.select("entity", "term", "b.seq", "b.text")


def coverage_report(covered: DataFrame, specs: DataFrame) -> DataFrame:
    """Per pair of classes: terms covered, percent (truncated), required gaps, and what an alignment check would find.

    Missing preferred terms are reported up to five, in order of their names.
    """
    sets = entity_sets(covered.withColumn("strength", F.lit(1.0)), specs)
    c = coverage(sets, specs)
    missing = lambda level: F.transform(F.filter("needs", lambda x: (x["importance"] == level) & ~F.array_contains("have", x["term"])), lambda x: x["term"])
    return c.select(
        "entity_class", "n_entities", "spec_class", "n_specs", "matched", F.expr("cast(100 * matched div size(needs) as long)").alias("percent"), missing(0).alias("required_gaps"),
        F.slice(missing(1), 1, 5).alias("preferred_missing"),
    )


def discover_evidence(skills: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, skill, text, confidence 0.85) of known skills of two letters or more named in texts(entity, text)."""
    names = skills.select("skill").where(F.length("skill") >= 2).distinct()
    met = mentioned(names, texts.select("text")).join(names, F.col("phrase") == F.lower("skill"))
    own = texts.select("entity", "text").distinct().withColumn("digest", digest(F.col("text")))
    return own.join(met.select("skill", "digest"), "digest").select("entity", "skill", "text", F.lit(0.85).alias("confidence"))


def title_reflected(title: Column, summary: Column) -> Column:
    """Whether a word of over three letters of the title is in the summary."""
    return F.exists(F.split(F.lower(title), " "), lambda w: (F.length(w) > 3) & F.lower(summary).contains(w))


def gap_sets(best: DataFrame, adjacent: DataFrame, specs: DataFrame, weak: float = 0.4) -> DataFrame:
    """(terms_id, states, n_entities): entities with a match, by the state of every term they have or are near to."""
    asked = specs.where(F.col("spec") == F.col("terms_id")).select("terms_id", F.explode("terms").alias("term"))
    state = F.when(F.round("strength", 6) >= weak, "none").otherwise("weak")
    own = best.select("entity", "term", state.alias("state"), F.lit(1).alias("has"))
    near = adjacent.select("entity", "term").distinct().join(best.select("entity", "term"), ["entity", "term"], "left_anti").select("entity", "term", F.lit("adjacent").alias("state"), F.lit(0).alias("has"))
    rows = own.unionByName(near).join(asked, "term").groupBy("entity", "terms_id").agg(F.array_sort(F.collect_set(F.struct("term", "state"))).alias("states"), F.max("has").alias("has"))
    return rows.where("has = 1").groupBy("terms_id", "states").agg(F.count("*").alias("n_entities"))


def career_gaps(states: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, term, gap, impact, effort, n): how many entities have each gap of each spec they match at all."""
    s = specs.where(F.col("spec") == F.col("spec_class")).select("terms_id", "spec_class", F.explode("needs").alias("need"))
    of = lambda c: F.get(F.filter("states", lambda x: x["term"] == F.col("need.term")), 0)["state"]
    x = states.join(s, "terms_id").select("spec_class", "need", "n_entities", F.coalesce(of("states"), F.lit("true")).alias("gap")).where("gap <> 'none'")
    x = x.groupBy("spec_class", F.col("need.term").alias("term"), F.col("need.importance").alias("importance"), "gap").agg(F.sum("n_entities").alias("n"))
    gap, required = F.col("gap"), F.col("importance") == 0
    impact = F.when(gap == "weak", 0.5).when(gap == "adjacent", F.when(required, 0.7).otherwise(0.3)).otherwise(F.when(required, 0.9).otherwise(0.2))
    effort = F.when(gap == "weak", "Low").when(gap == "adjacent", "Medium").otherwise("High")
    return specs.select("spec", "spec_class").join(x, "spec_class").select("spec", "term", "gap", impact.alias("impact"), effort.alias("effort"), "n")


def actions_to_fit(states: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, actions, n_entities): required terms that are true or adjacent gaps, and how many entities have that many."""
    s = specs.where(F.col("spec") == F.col("spec_class")).select("terms_id", "spec_class", "needs")
    have = F.transform(F.filter("states", lambda x: x["state"] != "adjacent"), lambda x: x["term"])
    x = states.join(s, "terms_id").withColumn("have", have)
    open_ = F.size(F.filter("needs", lambda n: (n["importance"] == 0) & ~F.array_contains("have", n["term"]))).cast("long")
    x = x.groupBy("spec_class", open_.alias("actions")).agg(F.sum("n_entities").alias("n_entities"))
    return specs.select("spec", "spec_class").join(x, "spec_class").drop("spec_class")


def squeezed_company(name: Column) -> Column:
    """Lower-cased name without blanks, commas, dots and legal forms, as domains spell it."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[ ,.]", ""), "inc|ltd|llc|corp", "")


def mail_match(mails: DataFrame, applications: DataFrame) -> DataFrame:
    """Best application of each mail: recruiter address 1.0, else domain 0.6 + title in subject 0.3 + company in text 0.2; at least 0.5.

    The first label of the sender's domain and the squeezed company meet by containment either way.  Three
    hash joins bring candidates: recruiter, label, and company names found in the text (with the title in
    the subject).  Applications of the same recruiter, company and title are one, by their smallest id.
    """
    m = mails.select("message_id", F.lower("sender").alias("sender"), F.lower("subject").alias("subject"), F.lower("body").alias("body"))
    m = m.withColumn("label", F.when(F.instr("sender", "@") > 0, F.element_at(F.split(F.expr("substring(sender, instr(sender, '@') + 1)"), "[.]"), 1)))
    # Dealt first, so that its joins go by the size of the rows and not by that of the compressed files, which let it be broadcast.
    m = m.repartition("message_id")
    a = applications.groupBy(F.lower("recruiter").alias("recruiter"), F.lower("company").alias("company"), F.lower("title").alias("title")).agg(F.min("application_id").alias("application_id"))
    a = a.withColumn("squeezed", squeezed_company(F.col("company")))
    labels, names = m.select("label"), a.select("squeezed")
    pairs = contained(labels, names).select(F.col("part").alias("label"), F.col("whole").alias("squeezed"))
    pairs = pairs.unionByName(contained(names, labels).select(F.col("whole").alias("label"), F.col("part").alias("squeezed"))).distinct().withColumn("domain", F.lit(True))
    title = F.coalesce((F.col("title") != "") & F.col("subject").contains(F.col("title")), F.lit(False))
    named = F.coalesce((F.col("company") != "") & (F.col("subject").contains(F.col("company")) | F.col("body").contains(F.col("company"))), F.lit(False))
    points = lambda c, x: F.when(c, x).otherwise(0.0)
    exact = m.join(a.where("recruiter <> ''"), F.col("sender") == F.col("recruiter")).select("message_id", "application_id", F.lit(1.0).alias("score"))
    other = ~F.coalesce((F.col("recruiter") != "") & (F.col("sender") == F.col("recruiter")), F.lit(False))
    domain = m.join(pairs, "label").join(a, "squeezed").where(other).select("message_id", "application_id", (0.6 + points(title, 0.3) + points(named, 0.2)).alias("score"))
    texts = m.select("message_id", F.explode(F.array("subject", "body")).alias("text"))
    told = mentioned(a.select("company"), texts.select("text")).join(texts.select("message_id", digest(F.col("text")).alias("digest")), "digest").select("message_id", F.col("phrase").alias("company")).distinct()
    by_text = told.join(m, "message_id").join(a, "company").where(other & title & named).select("message_id", "application_id", F.lit(0.5).alias("score"))
    both = exact.unionByName(domain).unionByName(by_text)
    best = both.groupBy("message_id").agg(F.max_by(F.struct("application_id", "score"), F.struct(F.round("score", 6).alias("s"), -F.col("application_id"))).alias("b"))
    return best.select("message_id", "b.application_id", "b.score").where(F.round("score", 6) >= 0.5)
