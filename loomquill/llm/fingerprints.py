"""Canonical exact digests, by SQL functions alone.

A text's canonical form is its compatibility-composed, case-folded form with white space folded to single
blanks. Its digest is two chained XXH64 values, 128 bits. Within every digest that several texts share the
canonical bytes themselves are compared, and forms that only collide get a number behind the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, partitions, release, texts, written

#: Stands for a null document id: the lowest of all.
LOWEST = -(2**63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can take it apart), white space to one blank, trimmed."""

    def compose(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def digest(form: Column) -> Column:
    """32 hex digits: the second XXH64 starts from the hash of 1."""

    def hexed(h: Column) -> Column:
        return F.lower(F.lpad(F.hex(h), 16, "0"))

    return F.concat(hexed(F.xxhash64(form)), hexed(F.xxhash64(F.lit(1), form)))


def bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that part the documents into about equal ranges, the last one the greatest; at most `buckets` of them."""
    at = [i / buckets for i in range(1, buckets)] or [1.0]
    row = docs.agg(F.percentile_approx("ord", at, 20 * buckets).alias("p"), F.max("ord").alias("m")).first()
    return sorted({*(row.p or []), *([row.m] if row.m is not None else [])})


def bucket_of(x: Column, cuts: list[int]) -> Column:
    """How many cuts lie below x, by two short scans of sorted arrays."""
    step = max(1, int(len(cuts) ** 0.5))
    whole = F.array(*[F.lit(c) for c in cuts])
    coarse = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]])
    first = F.size(F.filter(coarse, lambda c: c < x)) * step
    return first + F.size(F.filter(F.slice(whole, first + 1, F.lit(step)), lambda c: c < x))


def with_next(docs: DataFrame, form_digest=digest) -> DataFrame:
    """Each document with its digest and the text and digest of the next one by descending id (after the last: the first).

    Documents meet in ranges of ids; the greatest id of a range is copied to the range above it as a guest,
    behind that range's last document, and the greatest of all to the lowest range. Equal ids are ordered by text.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("ord", F.coalesce(F.col("doc_id"), F.lit(LOWEST)))
    cuts = bounds(docs, max(1, min(4096, 2 * partitions(spark)))) or [0]
    docs = docs.withColumn("fp", form_digest(canonical(F.col("text")))).withColumn("bucket", bucket_of(F.col("ord"), cuts))
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.when(F.col("ord") == cuts[-1], 0).otherwise(F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("guest"))
    spread = docs.select("doc_id", "text", "ord", "fp", F.explode(F.when(F.col("ord").isin(cuts), F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    w = Window.partitionBy("at.bucket").orderBy("at.guest", F.desc("ord"), "text")
    placed = spread.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)})
    return placed.where(~F.col("at.guest")).drop("ord", "at")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) characters give way to the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), following.substr(F.lit(1), half))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form_digest=digest) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Null texts count as empty; all texts of white space share one fingerprint. A null id is the lowest.
    Rows that repeat get equal fingerprints; a single document is its own next one; an empty table gives no rows.
    Likeness is 1 for equal fingerprints and 0 otherwise, as a digest can't be near.
    """
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col)
    pairs = with_next(base, form_digest).withColumn("edit", edited(F.col("text"), F.col("next_text"))).withColumn("edit_fp", form_digest(canonical(F.col("edit"))))
    rows = written(pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"), F.sha2("edit", 256).alias("edited_sha256"), F.sha2("next_text", 256).alias("next_sha"), "fp", "edit_fp", "next_fp"), "digests")
    release(spark)

    seen = rows.select(F.explode(F.array(F.struct(F.col("sha"), F.col("fp")), F.struct(F.col("edited_sha256").alias("sha"), F.col("edit_fp").alias("fp")))).alias("x")).select("x.*")
    shared = written(seen.groupBy("fp").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("fp"), "shared")
    # Equal raw texts have equal forms, so only digests shared by different texts need a look at the bytes.
    n = shared.count()
    if n:
        picked = F.broadcast(shared) if n <= BROADCAST_ROWS else shared
        forms = pairs.select(F.explode(F.array(F.struct(F.col("fp"), F.col("text").alias("t")), F.struct(F.col("edit_fp").alias("fp"), F.col("edit").alias("t")))).alias("x")).select("x.*")
        forms = forms.join(picked, "fp", "left_semi").select("fp", F.sha2("t", 256).alias("sha"), canonical(F.col("t")).alias("form"))
        clash = written(forms.groupBy("fp").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("fp"), "clash")
        if not clash.isEmpty():
            ranks = written(forms.join(clash, "fp", "left_semi").distinct().select("fp", "sha", F.dense_rank().over(Window.partitionBy("fp").orderBy("form")).alias("k")), "ranks")
            for fp, sha in (("fp", "sha"), ("edit_fp", "edited_sha256"), ("next_fp", "next_sha")):
                named = ranks.select(F.col("fp").alias(fp), F.col("sha").alias(sha), "k")
                rows = rows.join(named, [fp, sha], "left").withColumn(fp, F.when(F.col("k") > 1, F.concat(fp, F.lit("-"), F.col("k").cast("string"))).otherwise(F.col(fp))).drop("k")
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edit_fp").alias("edited_fingerprint"), same("fp", "edit_fp").alias("near_edited"), same("fp", "next_fp").alias("near_next"))
