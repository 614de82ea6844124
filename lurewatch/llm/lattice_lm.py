"""Language model scores: marginal probability over all subword segmentations of a text.

The vocabulary is that of a public tokenizer (its file is a parameter; nothing of it is trained).  Unigram scores of its
pieces come from the training documents: every training word counts for the pieces that the tokenizer cuts it into.  A
word's probability is the sum over all segmentations into pieces, by forward recursion in log space over the lattice of
its characters; a character outside the vocabulary is spelled in byte pieces.  No piece spans two words, so a text's log
probability is the sum over its words and one end piece.

Word counts of the training documents are gathered whole (counted per task before the shuffle).  Scoring needs a count
for every word of every document: the ``HOT_WORDS`` most frequent words of at most ``HOT_BYTES`` bytes (so the table is
bounded) go to all tasks, so frequent words are never shuffled; every other word of a document is one row that meets
its count in a sort-merge join on the word, which can spill.

Edge cases: a null text is empty and holds the end token only; a null doc_id trains; repeated rows count and are scored
each; without training documents all counts are 0 and the piece scores are uniform; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import LONG_WORD, id_text, stored

HOT_WORDS, HOT_BYTES, HELD_WORDS, HELD_BYTES, FOLDS, HELD_FOLD = 200_000, 64, 400_000, 1 << 27, 7, 2
END = b"\n"  # no word holds a line end
SPACE = "▁"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over the training documents, END among the words; counted in tasks first."""

    def run(batches):
        seen: Counter = Counter()
        size = 0  # of the texts whose words are held

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(text.lower().split())
                seen[END] += 1
                size += len(text)
                if len(seen) > HELD_WORDS or size > HELD_BYTES:
                    yield out()
                    seen.clear()
                    size = 0
        if seen:
            yield out()

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(counts: DataFrame, model_file: str) -> DataFrame:
    """``piece, c``: how often the tokenizer uses each piece id for the counted words; at most one row per piece and task before the shuffle."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for b in batches:
            words, c = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], b.column(1).to_numpy()
            if words:
                ids = sp.encode(words, num_threads=1)
                np.add.at(total, np.concatenate([np.array(x, np.int64) for x in ids] or [np.empty(0, np.int64)]), np.repeat(c, [len(x) for x in ids]))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "c"])

    return counts.where(F.col("word") != F.lit(END)).mapInArrow(run, "piece long, c long").groupBy("piece").agg(F.sum("c").alias("c"))


class Lattice:
    """Natural log probability of a word over all its segmentations; remembers a bounded number of words."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float], most: int = HELD_WORDS):
        self.trie: dict = {}
        for piece, score in scores.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = score
        self.chars = {p for p in scores if len(p) == 1}
        self.byte_scores, self.memo, self.most = byte_scores, {}, most

    def __call__(self, word: bytes) -> float:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            known = self.forward(SPACE + word.decode("utf-8", "replace"))
            if len(word) <= LONG_WORD:
                self.memo[word] = known
        return known

    def forward(self, s: str) -> float:
        """Log-sum over all paths; ``a[j]`` sums the segmentations of the first j characters."""
        low, exp, log1p = -math.inf, math.exp, math.log1p
        a = [low] * (len(s) + 1)
        a[0] = 0.0
        trie, chars = self.trie, self.chars
        n = len(s)
        for i in range(n):
            here = a[i]
            if s[i] not in chars:
                x, y = here + sum(self.byte_scores[b] for b in s[i].encode("utf-8", "replace")), a[i + 1]
                a[i + 1] = x if y == low else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
            node, j = trie, i
            while j < n:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                score = node.get("")
                if score is not None:
                    x, y = here + score, a[j]
                    a[j] = x if y == low else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return a[n]


def piece_scores(model_file: str, used: dict[int, int], ends: int) -> tuple[dict[str, float], list[float], float]:
    """Add-one unigram scores (natural logs) of all pieces, of the 256 byte pieces, and of the end piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    live = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = sum(used.get(i, 0) for i in live) + ends + len(live) + 1
    score = {i: math.log((used.get(i, 0) + 1) / total) for i in live}
    by_byte = [0.0] * 256
    for i in live:
        if sp.is_byte(i):
            by_byte[int(sp.id_to_piece(i)[3:5], 16)] = score[i]
    return {sp.id_to_piece(i): score[i] for i in live if not sp.is_byte(i)}, by_byte, math.log((ends + 1) / total)


def score_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    docs = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    counts = stored(word_counts(docs), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    used = {r.piece: r.c for r in piece_counts(counts, model_file).collect()}  # at most one row per piece of the vocabulary
    top = counts.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("c"), "word").limit(hot_words).toArrow()
    hot = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))
    ends = next((r.c for r in counts.where(F.col("word") == F.lit(END)).collect()), 0)
    hot |= {END: ends} if ends else {}
    model = spark.sparkContext.broadcast((piece_scores(model_file, used, ends), hot))
    unit = math.log10(n + v + 1) if n + v else 0.0

    def run(batches):
        (pieces, by_byte, end_score), hot = model.value
        lattice, row = Lattice(pieces, by_byte), TaskContext.get().partitionId() << 40
        logs = {w: math.log10(c + 1) for w, c in hot.items()}
        whole = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

        def out(rows, words, times, totals):
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int32()), pa.array(totals, whole)], names=["row", "word", "n", "doc"])

        for b in batches:
            rows, words, times, totals = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row += 1
                tokens = text.lower().split()
                rare = Counter([w for w in tokens if w not in logs])
                known = len(tokens) - sum(rare.values()) + (END in logs)
                base = sum([logs[w] for w in tokens if w in logs]) + logs.get(END, 0.0) - unit * (len(tokens) + 1)
                score = (sum(map(lattice, tokens)) + end_score) / math.log(10)
                rows += [row] * (len(rare) + 1)
                words += [b" %d" % row, *rare]  # no word starts with a blank: the document's own row meets no count
                times += [0, *rare.values()]
                totals += [{"doc_id": doc_id, "n_tokens": len(tokens) + 1, "n_known": known, "base": base, "score": score}, *[None] * len(rare)]
                if len(rows) > 200_000:
                    yield out(rows, words, times, totals)
                    rows, words, times, totals = [], [], [], []
            if rows:
                yield out(rows, words, times, totals)

    rows = docs.mapInArrow(run, "row long, word binary, n int, doc struct<doc_id:long,n_tokens:long,n_known:long,base:double,score:double>")
    met = rows.join(counts.hint("merge"), "word", "left").where("doc IS NOT NULL OR c IS NOT NULL")
    sums = met.groupBy("row").agg(
        F.max("doc").alias("doc"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n") * F.log10(F.col("c") + 1)).otherwise(0.0)).alias("more"))
    return sums.select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "doc.n_tokens", (F.col("doc.n_known") + F.col("known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("doc.base") + F.col("more")).alias("base_score"), F.col("doc.score").alias("score"))
