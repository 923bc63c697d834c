"""Per-document text statistics and an outlier score from exact per-language ranks.

1. One map over Arrow batches gives each text's statistics, as they are, and its
   language group (by its own words and script, since the column can be wrong).
2. The values are counted per (language, statistic) with map-side combining, the counts
   are range-partitioned and sorted, and running sums within a partition plus the
   offsets of the partitions before it give exact ranks.  No partition holds more than
   its range, however uneven the values.  The ranks are joined back by value; a value
   that very many texts share is one row of the ranks and a skewed left side.
3. A text's tail probabilities, P(X <= x) and P(X >= x) within its language, are
   combined into an outlier score: the weighted sum of their negative logarithms and of
   the logit of the rank between them, with an offset for the language; weights and
   offsets are fitted by logistic regression on a bounded sample of labelled documents.
   The score alone decides which documents are found.

Defined results: null, empty and blank texts have zero words, null ratios and no score
and are never found; of several labels the most frequent counts, on a tie the text is
not used for fitting; null labels are ignored; without labels of both kinds the score is
the plain sum of both tails, nothing tells what it means, and no document is found;
repeated rows each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import has_text
from ..session import cut, spread
from . import prose

#: The statistics that are ranked.
STATISTICS = ("log_words", "mean_word_len", "symbol_ratio", "digit_ratio", "line_end_share", "common_share", "prose_share")
LABELS_AT_MOST = 20_000
#: The probability from which a text is found, and the ridge on the weights and on the languages' offsets.
FOUND_AT, RIDGE, OFFSET_RIDGE = 0.5, 1.0, 0.25
_DIGIT = re.compile(r"\d")


def measure(text: str | None, by_lang: dict[str, frozenset[str]], common: frozenset[str]) -> tuple | None:
    """(language group, words, statistics...) of one text; None where it is blank."""
    if text is None or not text.strip():
        return None
    n = len(text)
    t = prose.tally(text, common)
    cjk = 0 if text.isascii() else len(prose.CJK.findall(text))
    if cjk > 0.2 * n:
        group = "cjk"
    else:
        hits = {lang: sum(map(own.__contains__, t.common)) for lang, own in by_lang.items()} if t.common else {}
        group = max(sorted(hits), key=hits.get) if hits else "und"
    values = (
        np.log2(t.words + 1), t.letters / max(1, t.words), len(prose.SYMBOL.findall(text)) / n, len(_DIGIT.findall(text)) / n, t.ended / max(1, t.lines), len(t.common) / max(1, t.words), t.share
    )
    return group, t.words, *map(float, values)


def statistics(texts: DataFrame, key_col: str, text_col: str, words: dict[str, list[str]]) -> DataFrame:
    """(key, lang_group, words, STATISTICS...): a map without a shuffle."""
    by_lang = {lang: frozenset(ws) for lang, ws in words.items()}
    common = frozenset(w for ws in words.values() for w in ws)
    names = ["lang_group", "words", *STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py(), by_lang, common) or (None, 0, *[None] * len(STATISTICS)) for t in batch.column(1)]
            columns = list(zip(*found)) if found else [[]] * len(names)
            types = [pa.string(), pa.int64(), *[pa.float64()] * len(STATISTICS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[key_col, *names])

    kind = texts.schema[key_col].dataType.simpleString()
    out = f"`{key_col}` {kind}, lang_group string, words long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return spread(texts.select(F.col(f"`{key_col}`"), F.col(f"`{text_col}`"))).mapInArrow(run, out)


def _listed() -> Column:
    """The statistics of a row as (stat, value), one row each."""
    return F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATISTICS])).alias("v")


def ranks(stats: DataFrame) -> DataFrame:
    """(lang_group, stat, value, n, below, total): exact ranks of each value within its language."""
    counts = stats.filter("lang_group is not null").select("lang_group", _listed()).groupBy("lang_group", "v.stat", "v.value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("lang_group", "stat", "value").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)  # the partitions must stay as they are for the offsets
    group = ["lang_group", "stat"]
    sums = ranged.groupBy(*group, "part").agg(F.sum("n").alias("s"))
    before = F.sum("s").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*group, "part", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("s").over(W.partitionBy(*group)).alias("total"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy(*group, "part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inner", inner).join(offsets, [*group, "part"]).select(*group, "value", "n", (F.col("offset") + F.col("inner")).alias("below"), "total")


def tails(stats: DataFrame) -> DataFrame:
    """``stats``, which needs a unique ``row_id``, with ``x``: of every statistic the negative logarithms of both tail probabilities and the logit of the middle rank."""
    own = [c for c in stats.columns if c not in STATISTICS]
    each = stats.filter("lang_group is not null").select(*own, _listed()).select(*own, "v.stat", "v.value").join(ranks(stats), ["lang_group", "stat", "value"])
    left, right = -F.log((F.col("below") + F.col("n")) / F.col("total")), -F.log((F.col("total") - F.col("below")) / F.col("total"))
    middle = F.log((F.col("below") + F.col("n") / 2) / (F.col("total") - F.col("below") - F.col("n") / 2))
    of = lambda s, c: F.max(F.when(F.col("stat") == s, c))
    wide = each.groupBy(*own).agg(*[of(s, F.col("value")).alias(s) for s in STATISTICS], F.array(*[of(s, c) for s in STATISTICS for c in (left, right, middle)]).alias("x"))
    return wide.unionByName(stats.filter("lang_group is null").withColumn("x", F.lit(None).cast("array<double>")))


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float | np.ndarray = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression with a quadratic penalty, one for all or one a weight (Newton steps)."""
    if len(set(y.tolist())) < 2:
        return np.ones(x.shape[1]), 0.0
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag(np.append(np.broadcast_to(penalty, x.shape[1]), 1e-6))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled(labels: DataFrame, at_most: int = LABELS_AT_MOST) -> DataFrame:
    """(doc_id, junk) of at most ``at_most`` documents with a majority label, chosen by hash."""
    votes = labels.filter(has_text("label")).groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "prose", -1).otherwise(1)).alias("v"))
    return votes.filter("v <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most).select("doc_id", (F.col("v") > 0).cast("int").alias("junk"))


def scored(texts: DataFrame, labels: DataFrame, words: dict[str, list[str]], key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with its statistics, outlier score and the probability that it is no prose."""
    stats = cut(statistics(texts, key_col, text_col, words).withColumn("row_id", F.monotonically_increasing_id()))
    ranked = cut(tails(stats))
    known = labelled(labels).withColumnRenamed("doc_id", key_col)
    sample = ranked.filter("x is not null").join(F.broadcast(known), key_col).select("x", "lang_group", "junk").toPandas()  # at most LABELS_AT_MOST labels
    groups = sorted({*words, "cjk", "und"})
    fitted = sample["junk"].nunique() == 2
    if fitted:
        x = np.hstack([np.array(sample["x"].tolist()), np.array([[g == own for g in groups] for own in sample["lang_group"]], float)])
        weights, offset = fit_weights(x, sample["junk"].to_numpy(dtype=float), np.repeat([RIDGE, OFFSET_RIDGE], [3 * len(STATISTICS), len(groups)]))
    else:
        weights, offset = np.array([1.0, 1.0, 0.0] * len(STATISTICS) + [0.0] * len(groups)), 0.0
    score = sum((F.col("x")[i] * float(w) for i, w in enumerate(weights[: 3 * len(STATISTICS)])), F.lit(float(offset)))
    own = F.create_map(*[F.lit(v) for g, w in zip(groups, weights[3 * len(STATISTICS) :]) for v in (g, float(w))])[F.col("lang_group")]
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score")))))
    both = ranked.withColumn("score", score + own).withColumn("p_junk", F.when(F.col("score").isNotNull() & F.lit(fitted), p))
    return both.select(key_col, "lang_group", "words", *STATISTICS, "score", "p_junk")


def not_prose(scores: DataFrame, key_col: str = "doc_id", at: float = FOUND_AT) -> DataFrame:
    """The outliers: texts that are more likely than not no prose by their score."""
    return scores.filter(F.col("p_junk") >= at).select(key_col)
