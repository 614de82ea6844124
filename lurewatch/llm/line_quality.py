"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Viterbi decoding finds the best labelling of a document's lines; the share of words on content lines, together with
fixed base rules, decides whether the document is kept.

The field is fitted on at most ``FIT_DOCS`` labelled documents (those with the smallest md5 of their id; the only bounded
part: scoring sees every document, whole).  A document's label stands for all its lines; a Gaussian prior around the
hand-set ``PRIOR`` keeps the field sensible where labels are few or missing, so an empty label table works too.

Edge cases: a null text has no words and fails the base rules; blank lines carry no label; a document without words has
content share 0; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import id_text, small_batches

FIT_DOCS, CHAIN, STEPS = 2000, 256, 120
MIN_WORDS, MAX_REPEAT_PCT, WINDOW, MIN_SHARE = 20, 30, 8, 0.5

# Blanks and symbols of the contract, words that mark page furniture
BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
FURNITURE = frozenset(b"cookie cookies subscribe copyright login menu click reserved privacy terms signup share".split())
FEATURES = ["bias", "symbols", "many_symbols", "bars", "upper", "shouting", "sentence_end", "short", "long", "seen_before", "digits", "address", "furniture", "long_words", "no_letters"]
# weight of content over boilerplate, per feature; then the transition bonus of staying in a label
PRIOR = np.array([0.5, -1.5, -1.5, -1.5, -1.5, -1.5, 0.5, -0.3, 0.5, -0.5, -1.0, -0.5, -1.0, -0.5, -1.0, 0.5])
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    packed = text.translate(None, BLANK)
    chars = len(packed) - _continuation_bytes(packed)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line not in seen:
            seen.add(line)
        elif line.strip(BLANK):
            dup += 1
    return n, chars, symbols, dup, _repeat_words(words)


def _continuation_bytes(b: bytes) -> int:
    return 0 if b.isascii() else len(b) - len(b.translate(None, _CONTINUATION))


_CONTINUATION = bytes(range(0x80, 0xC0))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(WINDOW):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        acc ^= acc >> np.uint64(29)
    order = np.argsort(acc, kind="stable")
    same = acc[order][1:] == acc[order][:-1]
    if not same.any():
        return 0  # equal windows have equal hashes
    # windows with an equal hash are compared word by word
    maybe = np.zeros(m, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    first: dict[tuple, int] = {}
    hit = np.zeros(m, bool)
    for i in np.flatnonzero(maybe).tolist():
        k = first.setdefault(tuple(words[i : i + WINDOW]), i)
        if k != i:
            hit[i] = hit[k] = True
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(hit), 1)
    np.add.at(marks, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def line_features(text: bytes) -> tuple[list[int], list[int]]:
    """For each line with a word: the features it has (as bits) and its number of words."""
    bits, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = size - len(line.translate(None, _UPPER))
        letters = upper + size - len(line.translate(None, _LOWER)) + (0 if line.isascii() else 1)
        f = 1
        f |= (symbols > 0.2 * n) << 1 | (symbols > 0.8 * n) << 2 | (4 * line.count(b"|") > n) << 3
        f |= (upper > 0.5 * letters and upper > 3) << 4 | (line.count(b"!") > 0.3 * n) << 5
        f |= (words[-1][-1:] in b".?:;") << 6 | (n < 3) << 7 | (n >= 8) << 8 | (line in seen) << 9
        f |= (size - len(line.translate(None, _DIGIT)) > 0.3 * size) << 10 | (b"@" in line or b"://" in line) << 11
        f |= (not FURNITURE.isdisjoint(line.lower().split())) << 12 | (size > 16 * n) << 13 | (not letters) << 14
        seen.add(line)
        bits.append(f)
        sizes.append(n)
    return bits, sizes


def _matrix(bits) -> np.ndarray:
    return ((np.asarray(bits, np.int64)[:, None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


def fit_field(chains: list[tuple[np.ndarray, int]], steps: int = STEPS, prior_weight: float = 1.0) -> np.ndarray:
    """Weights by gradient ascent (Adam) on the penalised log-likelihood of the labelled chains (feature bits, label)."""
    cut = [(b[i : i + CHAIN], y) for b, y in chains for i in range(0, len(b), CHAIN)]
    if not cut:
        return PRIOR.copy()
    cut.sort(key=lambda c: len(c[0]))
    groups = [cut[i : i + 256] for i in range(0, len(cut), 256)]
    data = []
    for g in groups:
        t = max(len(b) for b, _ in g)
        x, on, y = np.zeros((len(g), t, len(FEATURES))), np.zeros((len(g), t)), np.array([c[1] for c in g], np.float64)
        for r, (b, _) in enumerate(g):
            x[r, : len(b)], on[r, : len(b)] = _matrix(b), 1
        data.append((x, on, y))
    total = sum(d[1].sum() for d in data)
    w, m, v = PRIOR.copy(), np.zeros_like(PRIOR), np.zeros_like(PRIOR)
    for step in range(1, steps + 1):
        grad = -prior_weight * (w - PRIOR) / total
        for x, on, y in data:
            grad += _chain_gradient(w, x, on, y) / total
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _chain_gradient(w: np.ndarray, x: np.ndarray, on: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Observed minus expected features (forward-backward); the label of a chain holds for all its lines."""
    s = np.stack((np.zeros(x.shape[:2]), x @ w[:-1]), axis=2)  # label 0 boilerplate, 1 content
    trans = np.array([[w[-1], 0.0], [0.0, w[-1]]])
    n, t = on.shape
    a, b = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    a[0] = s[:, 0]
    for i in range(1, t):
        a[i] = np.where(on[:, i, None] > 0, np.logaddexp.reduce(a[i - 1][:, :, None] + trans, axis=1) + s[:, i], a[i - 1])
    for i in range(t - 2, -1, -1):
        b[i] = np.where(on[:, i + 1, None] > 0, np.logaddexp.reduce(trans + (s[:, i + 1] + b[i + 1])[:, None, :], axis=2), b[i + 1])
    z = np.logaddexp.reduce(a[-1], axis=1)
    p1 = np.exp(a[:, :, 1] + b[:, :, 1] - z).T * on
    g = np.einsum("nt,ntf->f", y[:, None] * on - p1, x)
    stay = 0.0
    for i in range(1, t):
        pair = a[i - 1][:, :, None] + trans + (s[:, i] + b[i])[:, None, :] - z[:, None, None]
        stay += ((1 - np.exp(pair[:, 0, 0]) - np.exp(pair[:, 1, 1])) * on[:, i]).sum()
    return np.append(g, stay)


def viterbi(score: list[float], stay: float) -> list[int]:
    """Best labels of a chain: ``score`` is content over boilerplate for each line, ``stay`` the bonus of no change."""
    c = b = 0.0
    back = []
    for i, s in enumerate(score):
        if i:
            from_c, from_b = c + stay >= b, b + stay >= c
            back.append((from_c, from_b))
            c, b = (c + stay if from_c else b), (b + stay if from_b else c)
        c += s
    out = [int(c >= b)]
    for from_c, from_b in reversed(back):
        out.append((1 if from_c else 0) if out[-1] else (0 if from_b else 1))
    return out[::-1]


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", fit_docs: int = FIT_DOCS) -> np.ndarray:
    """Fit the field on a bounded sample of labelled documents; features are made in tasks."""
    picked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(quality_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    picked = picked.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_docs)

    def run(batches):
        for b in batches:
            rows = [(d, y, np.array(line_features(t)[0], np.uint16).tobytes()) for d, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "label", "bits"])

    rows = id_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, bits binary")
    # one row per labelled id, however often it is repeated
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "bits")).alias("r")).select("doc_id", "r.*").collect()
    rows = sorted((tuple(r) for r in rows), key=lambda r: (r[0], bytes(r[2])))
    return fit_field([(np.frombuffer(bytes(b), np.uint16), y) for _, y, b in rows if len(b)])


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"


def _judge(weights: np.ndarray):
    def run(batches):
        values = (np.arange(1 << len(FEATURES))[:, None] >> np.arange(len(FEATURES))) & 1
        table = (values @ weights[:-1]).tolist()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n
                bits, sizes = line_features(text)
                labels = viterbi([table[f] for f in bits], float(weights[-1])) if bits else []
                share = sum(s for s, y in zip(sizes, labels, strict=True) if y) / n if n else 0.0
                out.append((doc_id, n, chars, symbols, dup, repeat, failed, not failed and share >= MIN_SHARE, len(bits), sum(labels), share))
            if out:
                kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in VERDICT.split(", ")])

    return run


def judge_documents(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict for every document, one row per input row."""
    return id_text(docs, id_col, text_col).mapInArrow(_judge(weights), VERDICT)


def keep_good(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns; judged in one pass, nothing is shuffled."""

    @F.pandas_udf("boolean")
    def passes(texts):
        import pandas as pd

        judged = _judge(weights)([pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int64()), pa.array(texts.tolist(), pa.binary())], names=["doc_id", "text"])])
        return pd.Series([x for b in judged for x in b.column(7).to_pylist()])

    small_batches(docs.sparkSession)
    return docs.where(passes(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))))
