"""Line dedup by deletion neighbourhoods. DataFrame functions only.

Two lines are within one edit exactly if they are equal, or become equal when one of them or both
lose one character, both at the same place. So each line gives a hashed key for every character
left out:

* with the place: lines that share it differ in that character (a substitution);
* without it: a line that has this key as a whole is shorter by that character (an insertion).

In each group of a key only the earliest line is looked at, since all lines of it are within one edit of
each other (substitution), or of the one whole line (insertion). Nothing is paired within groups. The edit
distance of a line and its earlier partner is verified on the texts.

Hashes of the line without each character come from running XORs over (character, place), so a long line
costs as many steps as it has characters.

Lines that cannot have a partner give no keys. An edit lies in one half of a line, so the other half has to
occur in another line; and it lies in one of up to 64 short segments, so all around that has to occur too. Both are
tested for all lines, by counts of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.keys import KEY, keyed
from tillwatch.session import materialise

#: Shorter lines (blank ones, brackets, bullets) are part of the layout and stay.
MIN_CHARS = 10

ID = ["id1", "id2"]
LINES = r"\n"


def _halves() -> Column:
    """Hashes of the halves of a line, and of those that a line shorter by one would have."""
    line, keys = F.col("line"), []
    for m, own in ((F.col("chars"), True), (F.col("chars") - 1, False)):
        half = F.floor(m / 2).cast("int")
        for side, part in (("head", F.substr(line, F.lit(1), half)), ("tail", F.substr(line, F.col("chars") - (m - half) + 1, m - half))):
            keys.append(F.struct(F.xxhash64(F.lit(side), m, part).alias("half"), F.lit(own).alias("own")))
    return F.array(*keys)


#: Segments have at least so many characters, and a line has at most so many segments.
SEGMENT, SEGMENTS = 8, 64


def _around() -> Column:
    """Hashes of all around each segment of a line, and of what a line shorter by one would have there."""
    line, chars = F.col("line"), F.col("chars")

    def outside(m: Column, own: bool) -> Column:
        size = F.greatest(F.lit(SEGMENT), F.ceil(m / SEGMENTS).cast("int"))

        def key(k: Column) -> Column:
            tail = F.greatest(m - (k + 1) * size, F.lit(0))
            hashed = F.xxhash64(F.lit("around"), m, k, F.substr(line, F.lit(1), k * size), F.substr(line, chars - tail + 1, tail))
            return F.struct(hashed.alias("around"), F.lit(own).alias("own"))

        return F.transform(F.sequence(F.lit(0), F.ceil(m / size).cast("int") - 1), key)

    return F.concat(outside(chars, True), outside(chars - 1, False))


def _with_company(hashes: DataFrame, column: str) -> DataFrame:
    """Ids of the lines that share one of their ``hashes`` with another line, one of them as its own."""
    shared = hashes.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 AND own").select(column)
    return hashes.join(materialise(shared, column), column).select(*ID).distinct()


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """All keys of lines (id1, id2, first, chars, line): key, role, id1, id2, first."""
    chars = lines.select(*ID, "first", "chars", F.posexplode_outer(F.split("line", "")).alias("at", "c")).where("c <> ''")
    hashed = chars.select(*ID, "first", "chars", "at", F.xxhash64("c", "at").alias("here"), F.xxhash64("c", F.col("at") - 1).alias("moved"))
    one = Window.partitionBy(*ID)
    before = one.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    until = one.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select(
        *ID,
        "first",
        "chars",
        "at",
        F.coalesce(F.bit_xor("here").over(before), F.lit(0)).bitwiseXOR(F.bit_xor("moved").over(one)).bitwiseXOR(F.bit_xor("moved").over(until)).alias("left"),
        F.bit_xor("here").over(one).alias("whole"),
    )
    cut = F.struct(F.xxhash64(F.lit("cut"), F.col("chars") - 1, "left").alias("key"), F.lit("cut").alias("role"))
    same = F.struct(F.xxhash64(F.lit("same"), "chars", "at", "left").alias("key"), F.lit("same").alias("role"))
    whole = F.struct(F.xxhash64(F.lit("cut"), "chars", "whole").alias("key"), F.lit("whole").alias("role"))
    keys = F.when(F.col("at") == 0, F.array(cut, same, whole)).otherwise(F.array(cut, same))
    return summed.select(*ID, "first", F.inline(keys))


def _near(lines: DataFrame, max_edits: int) -> DataFrame:
    """Ids of the lines that have an earlier line within ``max_edits`` = 1."""
    keys = materialise(_neighbourhood(lines), "variants")
    first = F.struct("first", *ID)
    groups = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("role") == "same", first)).alias("same"),
        F.min(F.when(F.col("role") == "whole", first)).alias("whole"),
        F.min(F.when(F.col("role") == "cut", first)).alias("cut"),
    )
    groups = materialise(groups.where("n > 1").drop("n"), "groups")
    partner = F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "cut", F.col("whole")).otherwise(F.col("cut"))
    pairs = keys.join(groups, "key").withColumn("partner", partner).where(F.col("partner.first") < F.col("first"))
    pairs = pairs.select(*ID, F.col("partner.id1").alias("other1"), F.col("partner.id2").alias("other2")).distinct()
    texts = lines.select(*ID, "line")
    others = lines.select(F.col("id1").alias("other1"), F.col("id2").alias("other2"), F.col("line").alias("other"))
    checked = pairs.join(texts, ID).join(others, ["other1", "other2"])
    return checked.where(F.levenshtein("line", "other", max_edits).between(0, max_edits)).select(*ID).distinct()


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text left after line dedup, n_lines and n_removed.

    Lines end at ``\\n``. A line of at least ``min_chars`` code points goes if an earlier line of the
    input, gone itself or not, is equal or (``max_edits`` = 1) within one insertion, deletion or substitution of a
    code point. Shorter lines take no part: they stay, and are no earlier line for others, so a line of ``min_chars``
    stays if all it has is a neighbour shorter by one. Other values of ``max_edits`` are an error. Earlier is a smaller doc_id (null first), then a smaller hash of the text, then a smaller place.
    Lines that stay keep their order. Null texts stay null and have no lines, the empty text has one. Rows equal in
    id and text are one document and stay alike. Columns n_lines and n_removed of ``docs`` are replaced.
    Two lines count as equal if 128 bits of hash are; distances are verified on the texts.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = keyed(docs.drop("n_lines", "n_removed"))
    lines = docs.select(*KEY, F.posexplode_outer(F.split("text", LINES)).alias("n", "line")).withColumn("chars", F.length("line"))
    lines = lines.where(F.col("chars") >= min_chars).select(
        *KEY, "n", "chars", F.xxhash64("line").alias("id1"), F.xxhash64(F.lit(1), "line").alias("id2"), _halves().alias("halves")
    )
    lines = materialise(lines, "lines")
    distinct = lines.groupBy(*ID).agg(
        F.min(F.struct(*KEY, "n")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("chars").alias("chars"), F.min("halves").alias("halves")
    )
    distinct = materialise(distinct, "distinct")
    marked = distinct.where("copies > 1").select(*ID, "first", F.lit(False).alias("near"))
    if max_edits:
        wanted = _with_company(distinct.select(*ID, F.inline("halves")), "half")
        wanted = wanted.join(distinct.select(*ID, "first", "chars"), ID)
        wanted = wanted.groupBy(*[F.col(f"first.{k}") for k in KEY]).agg(
            F.collect_list(F.struct(*ID, F.struct("first.*").alias("first"), "chars")).alias("wanted")
        )
        split = docs.select(*KEY, F.split("text", LINES).alias("split")).join(wanted, KEY)
        taken = F.transform("wanted", lambda w: F.struct(w["id1"].alias("id1"), w["id2"].alias("id2"), w["first"].alias("first"), w["chars"].alias("chars"), F.get("split", w["first"]["n"]).alias("line")))
        candidates = materialise(split.select(F.inline(taken)).dropDuplicates(ID), "candidates")
        close = _with_company(candidates.select(*ID, F.inline(_around())), "around")
        near = materialise(_near(materialise(candidates.join(close, ID), "close"), max_edits), "near")
        marked = marked.join(near, ID, "left_anti").unionByName(near.join(distinct, ID).select(*ID, "first", F.lit(True).alias("near")))
    marked = materialise(marked, "marked")
    gone = lines.select(*KEY, "n", *ID).join(marked, ID).where(F.col("near") | (F.struct(*KEY, "n") != F.col("first")))
    gone = gone.groupBy(*KEY).agg(F.collect_set("n").alias("__gone"))
    split = F.split("text", LINES)
    left = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), "__gone")
    joined = docs.join(gone, KEY, "left").withColumns(
        {
            "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        }
    )
    # As the output of a generator the split is made once; otherwise it would be moved into the lambda below.
    joined = joined.select("*", F.inline_outer(F.array(F.struct(F.when(F.col("__gone").isNotNull(), split).alias("__split")))))
    rest = F.array_join(F.transform(left, lambda i: F.get("__split", i)), "\n")
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest)).drop(*KEY, "__gone", "__split")
