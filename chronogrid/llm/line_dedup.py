"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as word sequences, so white space doesn't count, and an edit is the
insertion, deletion or substitution of one word. A line of `min_words` words or more goes when
an earlier line (smaller id, or same id and earlier line) is equal or one edit away; a shorter
line goes only for an equal one. Lines without words stay. The bound is a definition: one edit
in 8 words leaves 7/8 of them, above the 0.8 that near duplicates take, while in shorter lines
(headings, list items, names with a number) one word is mostly what the line is about.

Equal lines: a grouped minimum keeps each distinct line's first place, with map-side combining.
Candidates: one edit leaves the first or the last words of a line as they were, so only distinct
lines that share either with another line can have a partner, and only the rest can differ.
Neighbourhood: candidates emit a hashed key for every deletion there and for the whole line;
a key is an exclusive-or over (word, place) pairs, and all keys of a line are running ones, in
time n log n in its words. Equal keys mean equal words, but for collisions of 64-bit hashes.
Lines with equal keys are paired with the key's earliest line and the edit distance of each
pair is verified on its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct_ids, materialize, table, words

#: Stands for a null id, which ranks after all others.
_LAST = 2**63 - 1
_STRIDE = "4294967296"
#: Found in lines that have a word.
_WORDY = r"[^\x20\x09-\x0D]"


def _place(row_id: Column, line: Column) -> Column:
    """One number that orders lines by id, then line."""
    return (row_id.cast("decimal(20,0)") * F.lit(_STRIDE).cast("decimal(11,0)") + line.cast("decimal(10,0)")).cast("decimal(38,0)")


def _line_of(place: Column) -> Column:
    return F.pmod(place, F.lit(_STRIDE).cast("decimal(11,0)")).cast("int")


def _id_of(place: Column) -> Column:
    return ((place - _line_of(place).cast("decimal(10,0)")) / F.lit(_STRIDE).cast("decimal(11,0)")).cast("decimal(20,0)").cast("long")


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("_id", F.posexplode(F.split("_text", "\n")).alias("_ln", "_line"))
    # A filter on the words would be moved before them and split each line twice.
    return lines.filter(F.col("_line").rlike(_WORDY)).select("_id", "_ln", words(F.col("_line")).alias("_w"))


def _part(n: Column) -> Column:
    """The largest power of two that is at most n / 2."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n / 2) + 1e-9)).cast("int")


def _ends(least: int) -> list[Column]:
    """Keys of the first and last p words of lines of `least` words or more, p = _part(number of words); null in others.

    One edit leaves one of the two as it was. Where the shorter line of a pair would have half
    the p, both p are used.
    """
    n = F.size("_w")
    p = _part(n)
    half, long = (p / 2).cast("int"), n >= least
    keys = lambda q: [F.xxhash64(F.lit("first"), q, F.slice("_w", 1, q)), F.xxhash64(F.lit("last"), q, F.slice("_w", n - q + 1, q))]
    return [F.when(long, k) for k in keys(p)] + [F.when(long & (p * 2 == n), k) for k in keys(half)]


def _neighbourhood() -> tuple[Column, Column]:
    """(hash of the whole line, given it as _t the keys of its deletions at _from.._to - 1 and of the whole, at -1).

    A hash is the exclusive-or over pairs of a word and its place. As a place holds one word, no
    pair occurs twice, and lines with equal hashes have the same words in the same order.
    """
    n = F.size("_w")
    word = lambda i, place: F.xxhash64(F.get("_w", i), place)
    xor = lambda a, b: a.bitwiseXOR(b)
    whole = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, i: xor(acc, word(i, i)))
    # The key of the first deletion, and how each further key differs from the one before it.
    first = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, i: F.when(i < F.col("_from"), xor(acc, word(i, i))).when(i > F.col("_from"), xor(acc, word(i, i - 1))).otherwise(acc))
    steps = F.transform(F.sequence(F.col("_from"), F.col("_to") - 1), lambda i: F.when(i == F.col("_from"), first).otherwise(xor(word(i - 1, i - 1), word(i, i - 1))))
    # Running exclusive-or by doubling strides.
    strides = F.filter(F.array(*[F.lit(2**b) for b in range(31)]), lambda s: s < F.col("_to") - F.col("_from"))
    less = F.aggregate(strides, steps, lambda acc, s: F.transform(acc, lambda x, i: xor(x, F.coalesce(F.get(acc, i - s), F.lit(0).cast("long")))))
    keys = F.concat(
        F.array(F.struct(F.xxhash64("_t", n).alias("key"), F.lit(-1).alias("at"))),
        F.transform(less, lambda x, i: F.struct(F.xxhash64(x, n - 1).alias("key"), (i + F.col("_from")).alias("at"))),
    )
    return whole, keys


def _fetch(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (_of: a place, _what: a struct) with the words _w of the line there.

    docs is dealt by _id once for all joins with it, as each of them reads the same columns:
    the optimizer would leave _more out here, and deal the texts again, were it not in an
    expression (for texts shorter than nothing, so it never changes one).
    """
    text = F.when(F.octet_length("_text") < 0, F.col("_more").cast("string")).otherwise(F.col("_text"))
    lists = asked.select(_id_of(F.col("_of")).alias("_id"), F.struct(_line_of(F.col("_of")).alias("ln"), F.col("_what").alias("what")).alias("_a")).groupBy("_id").agg(F.collect_list("_a").alias("_asked"))
    found = docs.join(lists, "_id")
    found = found.select("_asked", F.posexplode(F.split(text, "\n")).alias("_ln", "_line"))
    found = found.select("_line", F.explode(F.filter("_asked", lambda a: a["ln"] == F.col("_ln"))).alias("_a"))
    return found.select(F.col("_a.what").alias("_what"), words(F.col("_line")).alias("_w"))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are within one insertion, deletion or substitution."""
    def same(short: Column, long: Column) -> Column:
        differs = F.zip_with(short, F.slice(long, 1, F.size(short)), lambda x, y: x != y)
        p = F.coalesce(F.array_position(differs, True), F.lit(0)).cast("int")
        p = F.when(p == 0, F.size(short)).otherwise(p - 1)
        return F.slice(short, p + 1, F.size(short)) == F.slice(long, p + 2, F.size(long))

    n, m = F.size(a), F.size(b)
    return F.when(n == m, F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) <= 1).when(m == n + 1, same(a, b)).when(n == m + 1, same(b, a)).otherwise(False)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, near: bool = True) -> DataFrame:
    """df's rows and columns with `text_col` cleaned, and n_lines, n_removed (replaced if df has them).

    Null text counts as empty (one line without words). Rows that share an id are documents of
    their own, ranked by a hash of their text. A null id ranks after all others (as 2^63 - 1).
    An empty table gives an empty table. `near=False` removes equal lines only.
    """
    other = [c for c in df.columns if c not in (text_col, "n_lines", "n_removed")]
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in other]).alias("_more"))
    docs = distinct_ids(docs)
    lines = _lines(docs)
    distinct = (
        lines.select(F.xxhash64("_w").alias("_h"), F.hash("_w").alias("_g"), F.size("_w").alias("_n"), _place(F.col("_id"), F.col("_ln")).alias("_place"), *[k.alias(f"_k{i}") for i, k in enumerate(_ends(max(4, min_words)))])
        .groupBy("_h", "_g", "_n")
        .agg(F.min("_place").alias("_place"), *[F.max(f"_k{i}").alias(f"_k{i}") for i in range(4)])
    )
    distinct = materialize(distinct.drop("_h", "_g"))
    kept = distinct.select("_place")
    if near:
        p = _part(F.col("_n"))
        shape = [(True, p), (False, p), (True, (p / 2).cast("int")), (False, (p / 2).cast("int"))]
        ends = distinct.filter(F.col("_n") >= max(4, min_words)).select("_place", "_n", F.explode(F.array(*[F.struct(F.lit(f).alias("first"), q.alias("p"), F.col(f"_k{i}").alias("k")) for i, (f, q) in enumerate(shape)])).alias("_e")).select("_place", "_n", "_e.*").filter("k is not null")
        shared = ends.groupBy("k").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("k")
        candidates = (
            ends.join(shared, "k", "left_semi")
            .groupBy("_place", "_n")
            .agg(F.min(F.when(F.col("first"), F.col("p"))).alias("_f"), F.min(F.when(~F.col("first"), F.col("p"))).alias("_l"))
            .select("_place", F.when(F.col("_l").isNull(), F.col("_f")).otherwise(0).alias("_from"), F.when(F.col("_f").isNull(), F.col("_n") - F.col("_l")).otherwise(F.col("_n")).alias("_to"))
        )
        whole, near_keys = _neighbourhood()
        asked = candidates.select(F.col("_place").alias("_of"), F.struct("_place", "_from", "_to").alias("_what"))
        keys = _fetch(docs, asked).select("_what.*", "_w").withColumn("_t", whole).select("_place", F.explode(near_keys).alias("_v")).select("_place", "_v.*")
        # Deletions at one place leave the same: a substitution. A deletion leaves the whole of another line: an insertion.
        ties = (
            keys.groupBy("key", "at")
            .agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_c"))
            .groupBy("key")
            .agg(
                F.min(F.when(F.col("at") < 0, F.col("_first"))).alias("_whole"),
                F.min(F.when(F.col("at") >= 0, F.col("_first"))).alias("_less"),
                F.collect_list(F.when((F.col("at") >= 0) & (F.col("_c") > 1), F.struct("at", "_first"))).alias("_same"),
            )
            .filter((F.size("_same") > 0) | (F.col("_whole").isNotNull() & F.col("_less").isNotNull()))
        )
        partner = F.when(F.col("at") < 0, F.array("_less")).otherwise(F.concat(F.array("_whole"), F.transform(F.filter("_same", lambda x: x["at"] == F.col("at")), lambda x: x["_first"])))
        pairs = keys.join(ties, "key").select("_place", F.explode(partner).alias("_first")).filter(F.col("_first") < F.col("_place")).distinct()
        both = pairs.select("_place", "_first", F.explode(F.array("_place", "_first")).alias("_of")).select("_of", F.struct("_place", "_first", "_of").alias("_what"))
        near_lines = (
            _fetch(docs, both)
            .select("_what.*", "_w")
            .groupBy("_place", "_first")
            .agg(F.collect_list(F.when(F.col("_of") == F.col("_place"), F.col("_w"))).alias("_a"), F.collect_list(F.when(F.col("_of") == F.col("_first"), F.col("_w"))).alias("_b"))
            .filter(_one_edit(F.get("_a", F.lit(0)), F.get("_b", F.lit(0))))
            .select("_place")
            .distinct()
        )
        kept = kept.join(near_lines, "_place", "left_anti")
    stay = kept.select(_id_of(F.col("_place")).alias("_id"), _line_of(F.col("_place")).alias("_ln")).groupBy("_id").agg(F.collect_list("_ln").alias("_stay"))
    out = docs.join(stay, "_id", "left")
    out = out.withColumn("_all", F.split("_text", "\n"))
    out = out.withColumn("_left", F.filter("_all", lambda line, i: F.coalesce(F.array_contains("_stay", i), F.lit(False)) | ~line.rlike(_WORDY)))
    fields = [F.array_join("_left", "\n").alias(c) if c == text_col else F.col("_more")[c].alias(c) for c in df.columns if c not in ("n_lines", "n_removed")]
    return out.select(*fields, F.size("_all").cast("long").alias("n_lines"), (F.size("_all") - F.size("_left")).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars_kept, kept_sha256 of every document.

    Null and empty texts are one line without words, which stays. Repeated rows are documents of their own,
    of which the first keeps its lines; an empty table gives no rows.
    """
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: All pairs of lines with at most one differing word, by the same definition; DuckDB.
OP10_SQL = r"""
with l as (select doc_id, i, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
           from (select doc_id, unnest(generate_series(1, len(ls))) as i, unnest(ls) as t
                 from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
     f as (select w, min((doc_id, i)) as p from l where len(w) > 0 group by w),
     v as (select p, w, -1 as at, array_to_string(w, ' ') as k from f where len(w) >= 8
           union all
           select p, w, j as at, array_to_string(list_concat(w[1:j - 1], w[j + 1:]), ' ') as k
           from (select p, w, unnest(generate_series(1, len(w))) as j from f where len(w) >= 8)),
     g as (select distinct a.p from v a join v b on a.k = b.k and b.p < a.p
           where a.at = b.at and a.at > 0 or a.at = -1 and b.at > 0 or a.at > 0 and b.at = -1),
     s as (select l.*, len(l.w) = 0 or (l.doc_id, l.i) in (select p from f where p not in (select p from g)) as stays from l),
     r as (select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_removed,
                  coalesce(string_agg(t, chr(10) order by i) filter (stays), '') as kept from s group by doc_id)
select doc_id, n_lines, n_removed, length(kept) as n_chars_kept, sha256(kept) as kept_sha256 from r
"""
