"""Token ids of texts, word by word, for tokenizers whose tokens never span a blank."""

from __future__ import annotations

import os
import re
import sys

import numpy as np

from lurewatch.llm.common import LONG_WORD

HELD_PARTS = 400_000
#: Parts encoded in one line.
LINE_PARTS = 2_000
# in texts of Latin letters (without the two signs among U+00C0 to U+00FF) and ASCII without apostrophes (which the
# tokenizer reads with the letters behind them), it encodes runs of letters, single digits and runs of marks by themselves
_OTHER = re.compile("[^\\t-\\r -&(-~À-ÖØ-öø-ÿ]")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


class Remembered:
    """Entries in two generations: when the young one is full it becomes the old one, and old entries that nobody asked for
    meanwhile are gone.  So the number is bounded, and frequent ones stay."""

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def age(self) -> None:
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young


class WordIds:
    """Token ids (little-endian 32-bit) of texts, whose tokens never span a blank.

    Where the tokenizer's cuts are known (``_PARTS``), a text is looked up part by part in lower case; any other word is
    looked up whole.  Only what was not met before is encoded: parts many in a line, without the normaliser and pattern
    that have nothing left to do on them.  The memory is bounded, and long parts are forgotten at once.
    """

    def __init__(self, tokenizer_file: str, most: int = HELD_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.held = Remembered(most)

    @staticmethod
    def keys(raw: bytes) -> list[str | bytes]:
        """What a text's ids are looked up by: parts (str) and whole words (bytes)."""
        text = raw.decode("utf-8", "replace")
        if not _OTHER.search(text):
            return _PARTS.findall(text.lower())
        out: list[str | bytes] = []
        for word in raw.split():
            text = word.decode("utf-8", "replace")
            out += [word] if _OTHER.search(text) else _PARTS.findall(text.lower())
        return out

    def encode_parts(self, parts: list[str]) -> dict[str | bytes, bytes]:
        """Ids of parts: in one line, as a part's last token, and no other, ends a word."""
        out: dict[str | bytes, bytes] = {}
        for at in range(0, len(parts), LINE_PARTS):
            some = parts[at : at + LINE_PARTS]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                out.update(zip(some, [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:
                out |= self.encode_words(some)
        return out

    def encode_words(self, words: list) -> dict[str | bytes, bytes]:
        texts = [w if isinstance(w, str) else w.decode("utf-8", "replace") for w in words]
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)}

    def texts(self, texts: list[bytes]):
        """The ids of each text."""
        for at in range(0, len(texts), 256):
            keys = [self.keys(t) for t in texts[at : at + 256]]
            self.held.age()
            young, old = self.held.young, self.held.old
            found, asked = [], {}
            for k in keys:
                ids = list(map(young.get, k))
                if None in ids:
                    asked.update((w, old.get(w)) for w, i in zip(k, ids, strict=True) if i is None)
                found.append(ids)
            new = [w for w, ids in asked.items() if ids is None]
            asked |= self.encode_parts([w for w in new if isinstance(w, str)]) | self.encode_words([w for w in new if not isinstance(w, str)])
            young.update((w, ids) for w, ids in asked.items() if len(w) <= LONG_WORD)
            for k, ids in zip(keys, found, strict=True):
                yield b"".join([asked[w] if i is None else i for w, i in zip(k, ids, strict=True)] if None in ids else ids)


def word_ids(tokenizer_file: str) -> WordIds:
    """One ``WordIds`` per worker process and tokenizer, so that its tasks load the file and learn frequent words once.

    It lives beside the tokenizer library, because functions that travel by value have module variables of their own.
    """
    import tokenizers

    held = sys.modules[tokenizers.__name__].__dict__.setdefault("_held_word_ids", {})
    if tokenizer_file not in held:
        held[tokenizer_file] = WordIds(tokenizer_file)
    return held[tokenizer_file]
