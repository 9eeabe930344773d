"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio.

A document's n-grams (its words, and each word with the next) fall into ``BUCKETS`` hashed
buckets. The words' hash deals documents to two folds. A trusted multinomial is counted over
all trusted documents of each fold, the raw one over all documents; the raw one has add-one
smoothing, the trusted ones as much in the raw one's shares. A document scores the mean log ratio of its n-grams by the trusted multinomial of
the other fold, so that none is judged by its own counts or a copy's, and every trusted one
is counted and judged. It passes if it reaches the threshold, the score that all but
``MISSED`` of all trusted documents that pass the base rules reach (short texts have noisy
scores and fail anyway). DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 8192
#: Bits in the filter a trusted id, bits that each sets, most rows of 32,768 bits (32 MB in all), most wrong ids to broadcast.
BITS, MARKS, ROWS, WRONG = 32, 3, 8192, 1 << 18
#: Share of the trusted documents that pass the base rules that may score below the threshold.
MISSED = 0.001
#: SQL of the fold of ``words``: 0 or 1.
FOLD = "CAST(pmod(xxhash64(words), 2) AS INT)"
SPACE, WORD = r"[\\x20\\x09-\\x0D]+", r"[^\\x20\\x09-\\x0D]+"
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, words; null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("words", F.expr(f"regexp_extract_all(_text, '{WORD}', 0)"))


def _repeated(width: int) -> str:
    """SQL of the words covered by windows (hashes ``seen``, by position) that occur twice or more."""
    return f"""CASE WHEN size(array_distinct(seen)) = size(seen) THEN 0 ELSE
      element_at(transform(array(sort_array(transform(seen, (x, i) -> struct(x, i)))), s ->
        element_at(transform(array(sort_array(filter(
            transform(s, (e, k) -> CASE WHEN get(s, k - 1).x = e.x OR get(s, k + 1).x = e.x THEN e.i END), v -> v IS NOT NULL))),
          p -> aggregate(transform(p, (v, k) -> coalesce(least({width}, get(p, k + 1) - v), {width})), 0, (a, b) -> a + b)), 1)), 1) END"""


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, words and the base columns of each document."""
    own = _counted(docs, id_col, text_col).withColumns({"n_words": F.size("words").cast("long"), "lines": F.expr(r"filter(split(_text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')")})
    seen = f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(1, CAST(n_words AS INT) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) ELSE array() END"
    own = own.withColumns({
        "word_chars": F.expr("CAST(length(array_join(words, '')) AS LONG)"),
        "n_symbols": F.expr("CAST(length(regexp_replace(_text, '[^#*$%&|<>]+', '')) AS LONG)"),
        "n_dup_lines": F.expr("CAST(size(lines) - size(array_distinct(lines)) AS LONG)"),
        "seen": F.expr(seen),
    }).drop("_text", "lines")
    own = own.withColumn("n_repeat_words", F.expr(f"CAST({_repeated(WINDOW)} AS LONG)")).drop("seen")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return own.withColumn("base_failed", failed)


def _grams(value: str) -> str:
    """SQL that maps each word to ``value`` of its two buckets, {u} and {b}."""
    both = value.format(u=f"pmod(xxhash64(w), {BUCKETS})", b=f"pmod(xxhash64(w, get(words, i + 1)), {BUCKETS})")
    return f"transform(words, (w, i) -> {both})"


def trusted(labels: DataFrame, id_col: str) -> DataFrame:
    """_id of each trusted document (quality 1), once."""
    return labels.where("quality = 1").select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()


def _known(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_t and good (is the document trusted?) of each row, without a shuffle of texts.

    A broadcast filter of ``BITS`` bits an id says which documents may be trusted; of their ids
    alone, joined with the trusted ones, those that it is wrong about are found, and these are
    broadcast too. If they are more than ``WRONG`` (more ids than ``ROWS`` serve), or ids are
    neither whole numbers nor strings of one type, rows are joined as they are.
    """
    own, good = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), trusted(labels, id_col)
    kind = own.schema["_id"].dataType
    if kind == good.schema["_id"].dataType and isinstance(kind, (T.IntegralType, T.StringType)):
        all_good = labels.where("quality = 1").select(F.col(id_col).alias("_id")).where("_id IS NOT NULL")
        rows = min(ROWS, math.ceil(BITS * all_good.count() / 32768) or 1)
        row, at = f"pmod(shiftrightunsigned(xxhash64(_id), 45), {rows})", [f"(shiftrightunsigned(xxhash64(_id), {15 * i}) & 32767)" for i in range(MARKS)]
        bits = all_good.select(F.expr(row).alias("_k"), F.expr(f"explode(array({', '.join(at)}))").alias("p")).repartition("_k").groupBy("_k").agg(F.expr("bitmap_construct_agg(p)").alias("_bits"))
        is_set = " AND ".join(f"(shiftright(CAST(conv(hex(substring(_bits, CAST({p} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST({p} % 8 AS INT)) & 1) = 1" for p in at)
        may = F.expr(f"coalesce(_id IS NOT NULL AND {is_set}, false)").alias("may")
        told = lambda df, *c: df.withColumn("_k", F.expr(row)).join(F.broadcast(bits), "_k", "left").select("_id", *c, may)
        wrong = common.cut(told(own.select("_id")).where("may").select("_id").join(good, "_id", "left_anti").distinct())
        if wrong.count() <= WRONG:
            return told(own, "_t").join(F.broadcast(wrong.withColumn("no", F.lit(True))), "_id", "left").select("_t", F.expr("may AND no IS NULL").alias("good"))
        common.release(wrong)
    return own.join(good.withColumn("yes", F.lit(True)), "_id", "left").select("_t", F.expr("yes IS NOT NULL").alias("good"))


def log_ratios(known: DataFrame) -> list[tuple[float, float]]:
    """Log ratios of each bucket that judge fold 0 and fold 1, from :func:`_known`; none if a fold has no trusted words."""
    words = _counted(known, "good", "_t")
    dealt = words.select(F.expr(f"CASE WHEN _id THEN {FOLD} END").alias("fold"), "words")  # once a document, below the explode
    each = dealt.select("fold", F.explode(F.expr(f"flatten({_grams('array(CAST({u} AS INT), CAST({b} AS INT))')})")).alias("k"))
    counts = common.cut(each.groupBy("k").agg(F.count(F.lit(1)), F.count("fold"), F.sum("fold")))
    raw, good = [0] * BUCKETS, ([0] * BUCKETS, [0] * BUCKETS)
    for k, n, both, one in counts.collect():  # BUCKETS rows at most
        raw[k], good[0][k], good[1][k] = n, one or 0, both - (one or 0)
    common.release(counts)
    if not all(map(any, good)):
        return []
    all_raw = sum(raw) + BUCKETS
    shares, all_good = [(r + 1) / all_raw for r in raw], [sum(x) + BUCKETS for x in good]
    return [tuple(math.log((x[k] / share + BUCKETS) / n) for x, n in zip(good, all_good)) for k, share in enumerate(shares)]


def threshold(scored: DataFrame) -> float:
    """The least ``score`` that all but ``MISSED`` of the rows (as :func:`common.cut` left them) reach; minus infinity without rows."""
    rank = math.ceil(MISSED * scored.count())
    return scored.orderBy("score").limit(rank).agg(F.max("score")).first()[0] if rank else -math.inf


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[float, float]], float]:
    """(log ratios of each bucket for either fold, threshold). Without trusted documents in both folds all ratios are 0 and all pass."""
    known = _known(docs, labels, id_col, text_col)
    ratios = log_ratios(known)
    if not ratios:
        return [(0.0, 0.0)] * BUCKETS, -math.inf
    judged = rules(known.where("good"), "good", "_t").select("base_failed", score(ratios).alias("score"), F.monotonically_increasing_id().alias("_at"))
    scored = common.cut(judged.where(~F.col("base_failed") & (F.col("_at") >= 0)).select("score"))  # the filter stays above, as in passing()
    least = threshold(scored)
    common.release(scored)
    return ratios, least


def score(ratios: list[tuple[float, float]]) -> Column:
    """Mean log ratio over the n-grams of ``words``, by the ratios for their fold; 0 without words."""
    tables = ["CAST(split('" + ",".join(repr(r[i]) for r in ratios) + "', ',') AS ARRAY<DOUBLE>)" for i in (0, 1)]
    sums = [f"aggregate({_grams(f'get({t}, CAST({{u}} AS INT)) + get({t}, CAST({{b}} AS INT))')}, 0D, (a, x) -> a + x)" for t in tables]
    total = f"CASE WHEN {FOLD} = 0 THEN {sums[0]} ELSE {sums[1]} END"
    return F.expr(f"CASE WHEN size(words) = 0 THEN 0D ELSE ({total}) / (2 * size(words)) END")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, the base columns, score, base_failed, kept.

    Null and blank texts have no words and fail. Repeated rows are judged each for itself
    and counted each. Null ids are judged but never trusted. ``labels`` may be empty (then
    the base rules decide alone). Other columns are ignored.
    """
    ratios = log_ratios(_known(docs, labels, id_col, text_col))
    own = common.cut(rules(docs, id_col, text_col).withColumn("score", score(ratios or [(0.0, 0.0)] * BUCKETS)).drop("words"))
    least = threshold(own.where(~F.col("base_failed")).join(trusted(labels, id_col), "_id", "left_semi")) if ratios else -math.inf
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(least))
    return own.withColumn("kept", kept).withColumnRenamed("_id", id_col)


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, as they are."""
    ratios, least = fit(docs, labels, id_col, text_col)
    own = rules(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_t")), "_row", "_t")
    judged = own.select("_id", "base_failed", score(ratios).alias("score"), F.monotonically_increasing_id().alias("_at"))
    # A filter moves below deterministic columns and would compute them anew for each word; it stays above this one.
    return judged.where(~F.col("base_failed") & (F.col("score") >= F.lit(least)) & (F.col("_at") >= 0)).select("_id.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_rules(read("documents"), read("labels"))
