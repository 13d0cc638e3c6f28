"""Citation marks in a sentence: runs of marks, the text that each run owns, and the claims that belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import STOPWORDS, content_tokens, stem
from citeloom.functions.rules import first_match

# Fixed value: what may stand between two marks of one run.
_JOIN = r"(?i)^[\s,;\[\](){}\-‐‑‒–—―]*(?:and|&)?[\s,;\[\](){}\-‐‑‒–—―]*$"

#: Marks of a sentence in order: place and text.
MARKS = "array<struct<at: int, text: string>>"


def _end(mark: Column) -> Column:
    return mark["at"] + F.length(F.coalesce(mark["text"], F.lit("")))


def run_numbers(sentence: Column, marks: Column) -> Column:
    """Number of the run that each mark is in: marks are in one run where only separators stand between them."""
    between = lambda i: F.substring(sentence, _end(F.get(marks, i - 1)) + 1, F.greatest(F.get(marks, i)["at"] - _end(F.get(marks, i - 1)), F.lit(0)))
    starts = F.transform(marks, lambda _, i: (i > 0) & ~F.coalesce(between(i).rlike(_JOIN), F.lit(False)))
    return F.transform(starts, lambda _, i: F.size(F.filter(F.slice(starts, 1, i + 1), lambda s: s)))


def runs(sentence: Column, marks: Column) -> Column:
    """(at, end, n) of each run."""
    numbers = run_numbers(sentence, marks)
    held = F.arrays_zip(numbers.alias("run"), marks.alias("mark"))
    own = lambda r: F.transform(F.filter(held, lambda x: x["run"] == r), lambda x: x["mark"])
    one = lambda ms: F.struct(F.get(ms, 0)["at"].alias("at"), _end(F.element_at(ms, -1)).alias("end"), F.size(ms).alias("n"))
    return F.transform(F.array_distinct(numbers), lambda r: one(own(r)))


def regions(sentence: Column, found: Column) -> Column:
    """Text that each run owns: from the run before to its first mark. What follows the last run is nobody's."""
    start = lambda i: F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(F.lit(0))
    return F.transform(found, lambda r, i: F.substring(sentence, start(i) + 1, F.greatest(r["at"] - start(i), F.lit(0))))


def _of_others(lists: Column, i: Column) -> Column:
    """Values of all lists but the ith."""
    return F.array_distinct(F.flatten(F.filter(lists, lambda _, j: j != i)))


def anchors(own: Column) -> Column:
    """Content words just before each run, back to the first function word, without what other regions have."""
    tokens = F.transform(own, content_tokens)
    none = F.array().cast("array<string>")

    def tail(region: Column) -> Column:
        words = F.regexp_extract_all(F.lower(region), F.lit(r"(?U)[^\W_]+"), F.lit(0))
        return F.aggregate(words, none, lambda a, w: F.when(w.isin(STOPWORDS), none).otherwise(F.array_append(a, w)))

    def one(region: Column, i: Column) -> Column:
        words = F.array_except(F.filter(tail(region), lambda w: F.length(w) >= 3), _of_others(tokens, i))
        return F.array_union(words, F.array_except(F.transform(words, stem), _of_others(tokens, i)))

    return F.transform(own, one)


def claim_runs(own: Column, held: Column, claims: Column) -> Column:
    """Run of each claim (null: not told): the only one whose anchor it names, or, naming none, whose own words it shares."""
    tokens = F.transform(own, content_tokens)
    alone = F.transform(tokens, lambda t, i: F.array_except(t, _of_others(tokens, i)))
    whole = F.forall(held, lambda a: F.size(a) > 0) & (F.size(held) > 0)
    hits = lambda lists, c: F.filter(F.transform(lists, lambda x, i: F.when(F.arrays_overlap(x, c), i)), lambda i: i.isNotNull())
    only = lambda h: F.when(F.size(h) == 1, F.get(h, 0))

    def one(claim: Column) -> Column:
        c = content_tokens(F.coalesce(claim, F.lit("")))
        named = hits(held, c)
        return F.when(whole & (F.size(named) > 0), only(named)).when(whole, only(hits(alone, c)))

    return F.transform(claims, one)


def scope(style: Column, n_runs: Column, own_run: Column, n_claims: Column, assigned: Column) -> Column:
    """(status, reason): whether a reference is asked only its run's claims, or why it is asked all."""
    missing = F.exists(F.sequence(F.lit(0), F.greatest(n_runs - 1, F.lit(0))), lambda r: ~F.array_contains(assigned, r))
    reason = first_match(
        [
            (style != "numeric", "citation_style_not_numeric"),
            (n_runs < 2, "single_marker_cluster"),
            (n_claims == 0, "no_atomic_claims"),
            ((own_run < 0) | (own_run >= n_runs) | F.exists(assigned, lambda a: a.isNull()), "ambiguous"),
            (missing, "cluster_without_claims"),
        ],
        "",
    )
    return F.struct(F.when(reason == "", "scoped").otherwise("whole_sentence").alias("status"), reason.alias("reason"))


def partition_key(scope_id: Column, group_id: Column, citation_id: Column) -> Column:
    """Co-citation group of a reference: its run, else its sentence, else itself."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(scope_id), some(group_id), F.concat(F.lit("~solo~"), citation_id))


def numbering(marks: DataFrame, references: DataFrame) -> DataFrame:
    """``doc, number, rid`` of documents whose marks number the references by their place, without a single exception.

    ``marks``: doc, label, rids; ``references``: doc, ord (from 1), rid. At least
    one numeric mark of one reference must attest the scheme.
    """
    single = marks.where(F.trim("label").rlike(r"^\d+$") & (F.size("rids") == 1))
    said = single.select("doc", F.trim("label").try_cast("int").alias("ord"), F.get("rids", 0).alias("said"))
    held = said.join(references, ["doc", "ord"], "left").groupBy("doc").agg(F.min(F.coalesce(F.col("said") == F.col("rid"), F.lit(False))).alias("sound")).where("sound")
    return references.join(held.select("doc"), "doc", "left_semi").select("doc", F.col("ord").alias("number"), "rid")


def inferred_members(marks: DataFrame, numbers: DataFrame) -> DataFrame:
    """``doc, sentence, at, number, rid``: references inside a printed range, such as 4 in 3-5; all of a range or none.

    ``marks``: doc, sentence, at, label, rids, between (the text up to the next
    mark). Both ends must be numeric marks of the references that have these
    numbers, with nothing but a dash between them.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc", "sentence").orderBy("at")
    one = (F.size("rids") == 1) & F.trim("label").rlike(r"^\d+$")
    ends = marks.select("doc", "sentence", "at", "between", F.when(one, F.trim("label").try_cast("int")).alias("low"), F.get("rids", 0).alias("low_rid"))
    ends = ends.withColumns({"high": F.lead("low").over(order), "high_rid": F.lead("low_rid").over(order)})
    ranges = ends.where((F.col("high") > F.col("low") + 1) & F.trim("between").rlike(r"^[-‐‑‒–—―−]$"))
    number = lambda name, rid: numbers.select("doc", F.col("number").alias(name), F.col("rid").alias(rid))
    sound = ranges.join(number("low", "low_rid"), ["doc", "low", "low_rid"], "left_semi").join(number("high", "high_rid"), ["doc", "high", "high_rid"], "left_semi")
    inner = sound.select("doc", "sentence", "at", "low", "high", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1)).alias("number"))
    found = inner.join(numbers, ["doc", "number"], "left")
    whole = found.groupBy("doc", "sentence", "at").agg(F.count("rid").alias("n"), F.count(F.lit(1)).alias("m")).where("n = m")
    return found.join(whole.select("doc", "sentence", "at"), ["doc", "sentence", "at"], "left_semi").select("doc", "sentence", "at", "number", "rid")


def occurrence_ids(rows: DataFrame, order: str) -> DataFrame:
    """``occurrence_id``: the citation id, or, where there is none, the source and the row's place among all rows by ``order`` (a number)."""
    from citeloom.operators.ranking import spread_rank

    placed = spread_rank(rows.withColumns({"all_": F.lit(0), "minus_": -F.col(order)}), "all_", "minus_")
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("doc"))
    own = F.coalesce(F.nullif("citation_id", F.lit("")), F.concat(source, F.lit(":f2occ"), F.col("rank").cast("string")))
    return placed.withColumn("occurrence_id", own).drop("all_", "minus_", "rank")
