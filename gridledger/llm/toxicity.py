"""Toxic passages as maximal scoring segments over token log-odds.

A token's log-odds compare how often it occurs in labelled toxic and clean documents. Dirichlet priors smooth them along
a chain: a word is drawn towards its longest stem (a prefix of some bytes), that towards a shorter one, the last towards
the toxic share of all tokens, so that an unseen ending of a telling stem still counts. Tokens that don't tell share one
log-odds, slightly negative; one linear pass then finds all maximal segments (Ruzzo and Tompa). Their scores follow an extreme-value law (Karlin and
Altschul): its decay comes from the clean documents' token frequencies, and a sum statistic joins several segments.
A logistic curve over that statistic, fitted on the same labelled rows, gives the score between 0 and 1.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.textbytes import (
    alnum_bytes, chunks, flat, lower_latin, prefix_hashes, row_starts, rows_with_text, spans, stretch_hashes,
    text_of,
)
from gridledger.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)

LABELLED = 40_000      # bound of the labelled sample; rows beyond it do not train
MOST_TERMS = 200_000   # bound of the broadcast term table; beyond it the least certain terms go, with a warning
PRIOR = 4.0            # pseudo-documents of the Dirichlet prior
LEAST_BOUND = 0.5      # a term counts if its log-odds less DEVIATIONS of their spread are above this, however many prove it
DEVIATIONS = 2.6       # about one chance finding in two hundred terms
LEAST_DRIFT = 0.005    # what a token that doesn't tell costs at least
STEEPEST = 7.0
TOP = 60.0             # the statistic is held below this
THRESHOLD = 0.3
SIGNIFICANT = 0.05     # expected number of chance segments at which a passage is reported
STEMS = (4, 5, 7)      # bytes

TERM_SCHEMA = "level int, term long, parent long, n_toxic long, n_clean long, d_toxic long, d_clean long"
PASSAGES = "array<struct<first_byte: long, end_byte: long, score: double>>"


@dataclass
class Model:
    """What scoring needs: per level sorted term hashes with scores, the decay of chance scores, the logistic curve."""

    terms: list[tuple[np.ndarray, np.ndarray]]
    drift: float
    decay: float
    base: float = 0.0
    slope: float = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that never train: the checksum of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per level, shortest stem first and the whole word last, the hash of each token."""
    hashed = prefix_hashes(data)
    return [stretch_hashes(hashed, starts, np.minimum(starts + n, ends)) for n in STEMS] + [
        stretch_hashes(hashed, starts, ends)]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to occurrences and documents per term and class, added up within each slice.

    Words come in bursts, so ``n`` occurrences in one text count as ``1 + floor(log2(n))``.
    """
    member = alnum_bytes()
    for batch in batches:
        for part in chunks(batch):
            data, bounds = flat(part.column("text"))
            data = lower_latin(data)
            starts, ends, rows = spans(data, bounds, member)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            parent = np.zeros(len(starts), np.uint64)
            for level, term in enumerate(term_hashes(data, starts, ends)):
                order = np.lexsort((term, rows))
                t, r, p = term[order], rows[order], parent[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
                times = np.log2(np.diff(np.flatnonzero(new), append=len(t))).astype(np.int64) + 1
                t, r, p = t[new], r[new], p[new]
                distinct, at, which = np.unique(t, return_index=True, return_inverse=True)
                sums = [np.bincount(which, w, len(distinct)).astype(np.int64)
                        for w in (times * toxic[r], times * (1 - toxic[r]), toxic[r], 1 - toxic[r])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(distinct), level, np.int32)), pa.array(distinct.view(np.int64)),
                     pa.array(p[at].view(np.int64)), *(pa.array(s) for s in sums)],
                    ["level", "term", "parent", "n_toxic", "n_clean", "d_toxic", "d_clean"])
                parent = term


def with_odds(terms: DataFrame, parents: DataFrame | None, share: float) -> DataFrame:
    """Adds the smoothed toxic share, log-odds against the base share, and whether the term or a stem of it tells.

    A term tells if the lower end of its log-odds is high enough, where the spread comes from the number of documents:
    many occurrences in one document are one piece of evidence.
    """
    if parents is None:
        joined = terms.withColumn("prior", F.lit(share)).withColumn("stem_kept", F.lit(False))
    else:
        stems = parents.select(F.col("term").alias("parent"), F.col("share").alias("prior"),
                               F.col("kept").alias("stem_kept"))
        joined = terms.join(stems, "parent", "left").fillna({"prior": share, "stem_kept": False})
    toxic = F.col("n_toxic") + F.lit(PRIOR) * F.col("prior")
    clean = F.col("n_clean") + F.lit(PRIOR) * (F.lit(1.0) - F.col("prior"))
    return (
        joined.withColumn("share", toxic / (toxic + clean))
        .withColumn("odds", F.ln(toxic / clean) - F.lit(math.log(share / (1 - share))))
        .withColumn("spread", F.sqrt(F.lit(1.0) / (F.col("d_toxic") + F.lit(PRIOR) * F.col("prior"))
                                     + F.lit(1.0) / (F.col("d_clean") + F.lit(PRIOR) * (F.lit(1.0) - F.col("prior")))))
        .withColumn("clean", clean)
        .withColumn("kept", ((F.col("odds") - F.lit(DEVIATIONS) * F.col("spread") > LEAST_BOUND) & (F.col("d_toxic") >= 2))
                    | (F.col("stem_kept") & (F.col("d_toxic") + F.col("d_clean") >= 3)))
    )


def chance_decay(scores: np.ndarray, frequencies: np.ndarray, drift: float) -> float:
    """The positive root of sum(p * exp(decay * score)) = 1, where tokens outside the table score ``-drift``."""
    rest = max(0.0, 1.0 - float(frequencies.sum()))
    if not (scores > 0).any():
        return 1.0

    def above(decay: float) -> bool:
        return float((frequencies * np.exp(np.minimum(decay * scores, 700.0))).sum()) + rest * math.exp(-decay * drift) > 1.0

    low, high = 0.01, 20.0
    if above(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return low


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most ``LABELLED`` labelled documents (the smallest id hashes), never held-out ones.

    Only that bounded list of ids is broadcast, so the documents are not shuffled. Null ids and null labels do not
    train; an id with several labels is toxic if one of them is.
    """
    train = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    )
    return docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the term table, the decay and the curve. Without labels every text scores alike, below the threshold."""
    sample = labelled_sample(docs, labels)
    counts = sample.select("text", "toxic").mapInArrow(count_terms, TERM_SCHEMA)
    sums = [F.sum(c).alias(c) for c in ("n_toxic", "n_clean", "d_toxic", "d_clean")]
    counts = counts.groupBy("level", "term").agg(F.min("parent").alias("parent"), *sums)
    ensure_checkpoint_dir(docs.sparkSession)
    counts = counts.checkpoint()  # read once for the totals and once per level
    totals = counts.filter(F.col("level") == len(STEMS)).agg(F.sum("n_toxic").alias("toxic"), F.sum("n_clean").alias("clean")).first()
    n_toxic, n_clean = int(totals.toxic or 0), int(totals.clean or 0)
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    counts = counts.filter("d_toxic >= 2 OR d_toxic + d_clean >= 3")
    chain, levels = None, []
    for level in range(len(STEMS) + 1):
        chain = with_odds(counts.filter(F.col("level") == level), chain, share)
        levels.append(chain.filter("kept").select("level", "term", "odds", "clean", "spread"))
    kept = levels[0]
    for other in levels[1:]:
        kept = kept.unionByName(other)
    rows = kept.orderBy(F.desc(F.abs("odds") / F.col("spread")), "level", "term").limit(MOST_TERMS).collect()
    if len(rows) == MOST_TERMS:
        log.warning("more than %d terms tell; the least certain ones are left out", MOST_TERMS)
    tables = []
    for level in range(len(STEMS) + 1):
        mine = sorted((r.term % (1 << 64), r.odds) for r in rows if r.level == level)
        tables.append((np.array([t for t, _ in mine], np.uint64),
                       np.clip(np.array([o for _, o in mine], float), -STEEPEST, STEEPEST)))
    known = sample.mapInArrow(lambda batches: count_known(tables, batches), "toxic int, known long")
    known = {r.toxic: int(r.known or 0) for r in known.groupBy("toxic").agg(F.sum("known").alias("known")).collect()}
    other = (n_toxic - known.get(1, 0) + 1) / (n_toxic + 1) / ((n_clean - known.get(0, 0) + 1) / (n_clean + 1))
    drift = max(-math.log(other), LEAST_DRIFT)
    words = [r for r in rows if r.level == len(STEMS)]
    decay = chance_decay(np.clip(np.array([r.odds for r in words], float), -STEEPEST, STEEPEST),
                         np.array([r.clean for r in words], float) / max(n_clean, 1), drift)
    model = Model(tables, drift, decay)
    seen = measure(sample, model, ["toxic"]).groupBy(F.col("doc.toxic").alias("toxic"),
                                                     (F.round(F.col("evidence") * 2) / 2).alias("x")).count().collect()
    model.base, model.slope = logistic([(r.x, r.toxic, r["count"]) for r in seen])
    return model


def logistic(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton steps on counted cells.

    The statistic is the negative logarithm of a chance, so the slope stays between 0 and 1, also where the labelled
    rows separate; a weak ridge keeps the intercept finite then.
    """
    x = np.array([c[0] for c in cells], float)
    y = np.array([c[1] for c in cells], float)
    n = np.array([c[2] for c in cells], float)
    if not len(x) or not (n * y).sum() or not (n * (1 - y)).sum():
        return -3.0, 0.0
    beta, ridge = np.array([math.log((n * y).sum() / (n * (1 - y)).sum()), 0.0]), np.diag([1e-3, 1e-2])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge @ beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, gradient)
        before, beta = beta, beta + np.clip(step, -1, 1)
        if not 0 <= beta[1] <= 1:  # at the bound the intercept moves alone
            beta[1] = min(max(beta[1], 0.0), 1.0)
            beta[0] = before[0] + float(np.clip(gradient[0] / ((n * p * (1 - p)).sum() + ridge[0, 0]), -1, 1))
        if np.abs(beta - before).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def token_scores(tables: list[tuple[np.ndarray, np.ndarray]], levels: list[np.ndarray], other: float) -> np.ndarray:
    """The score of the longest known form of each token, ``other`` for tokens without one."""
    scores = np.full(len(levels[0]), other)
    for (terms, values), hashes in zip(tables, levels):
        if len(terms):
            some = np.zeros(1 << 16, bool)
            some[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(some[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(terms, hashes[maybe]), len(terms) - 1)
            known = terms[at] == hashes[maybe]
            scores[maybe[known]] = values[at[known]]
    return scores


def count_known(tables: list[tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens of each labelled text have a form in the table."""
    member = alnum_bytes()
    for batch in batches:
        for part in chunks(batch):
            data, bounds = flat(part.column("text"))
            data = lower_latin(data)
            starts, ends, rows = spans(data, bounds, member)
            told = ~np.isnan(token_scores(tables, term_hashes(data, starts, ends), math.nan))
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array(np.bincount(rows[told], minlength=part.num_rows))], ["toxic", "known"])


def tells(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a word adds evidence: of a run of one word the 1st, 2nd, 4th, 8th and so on do, as in the counts."""
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
    at = np.arange(len(words))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) + 1
    return nth & (nth - 1) == 0


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), in one pass over the positive tokens.

    Candidates keep the running total before and after them. A new one looks back along links to the nearest candidate
    that starts lower; if that one also ends lower, both join and the search goes on from there.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    first, end, low, high, link = [], [], [], [], []
    for at in np.flatnonzero(scores > 0).tolist():
        f, lo, hi = at, total[at], total[at + 1]
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            f, lo = first[j], low[j]
            for kept in (first, end, low, high, link):
                del kept[j:]
        first.append(f), end.append(at + 1), low.append(lo), high.append(hi), link.append(j)
    return [(f, e, float(b - a)) for f, e, a, b in zip(first, end, low, high)]


def joint_evidence(segments: list[float], n_tokens: int, decay: float) -> float:
    """Minus the log of the chance that a clean text of this length holds segments as good as the best r, over all r."""
    best, total, fact = 0.0, 0.0, 0.0
    for r, score in enumerate(sorted(segments, reverse=True), 1):
        total += decay * score - math.log(max(n_tokens, 1))
        if total <= 0:
            break
        fact += math.log(r) + (math.log(r - 1) if r > 1 else 0.0)
        best = max(best, total - (r - 1) * math.log(total) + fact)
    return min(best, TOP)


def score_texts(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    member = alnum_bytes()
    kind = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        for part in chunks(batch):
            data, bounds = flat(text_of(part))
            data = lower_latin(data)
            starts, ends, rows = spans(data, bounds, member)
            first = row_starts(rows, part.num_rows)
            levels = term_hashes(data, starts, ends)
            scores = token_scores(model.terms, levels, -model.drift)
            scores[~tells(levels[-1], rows)] = -model.drift
            evidence, passages = np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
            for row in np.unique(rows[scores > 0]).tolist():
                lo, hi = int(first[row]), int(first[row + 1])
                found = maximal_segments(scores[lo:hi])
                evidence[row] = joint_evidence([s for _, _, s in found], hi - lo, model.decay)
                passages[row] = [
                    {"first_byte": int(starts[lo + f] - bounds[row]), "end_byte": int(ends[lo + e - 1] - bounds[row]), "score": s}
                    for f, e, s in found if (hi - lo) * math.exp(-model.decay * s) <= SIGNIFICANT]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(evidence), pa.array(passages, kind)], ["doc", "evidence", "passages"])


def measure(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``doc`` (the named columns), ``evidence`` and the significant ``passages`` (bytes of the UTF-8 text) per row."""
    rows = rows_with_text(docs, columns)
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, evidence double, passages {PASSAGES}"
    return rows.mapInArrow(lambda batches: score_texts(model, batches), schema)


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``doc, score, predicted, passages`` for every row. Null and empty texts score as texts without passages."""
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.base) + F.lit(model.slope) * F.col("evidence"))))
    return measure(docs, model, columns).select("doc", score.alias("score"), "passages").select(
        "doc", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic; columns unchanged. Labels teach the model, they do not decide on rows."""
    return scored(docs, fit(docs, labels), docs.columns).filter("predicted = 0").select("doc.*")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out, score, prediction, and the number of significant passages.

    Null and empty texts score as texts without passages. Repeated rows score alike; of labels that tie on an id, any
    toxic one counts. Very long texts are scored whole, as a slice of their own. An empty table gives none. Only the id
    and the text are read.
    """
    return scored(docs, fit(docs, labels), ["doc_id"]).select(
        F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted",
        F.size("passages").alias("n_passages"))
