"""Whole-text encoding with a public tokenizer, once per distinct chunk instead of once per occurrence.

Both supported pre-tokenizers start a new piece at a space that a non-space follows, and at a lone line end, so a text
cut there encodes to the concatenation of its chunks' ids; one of them drops white space altogether. Chunks repeat a lot,
and a document is a join of cached id strings; but most distinct chunks come once, so a worker keeps those that the library
has seen before (a table of SEEN hashes says so; the cache is emptied at CACHE_ENTRIES chunks, long chunks are not kept).
New chunks go to the library many in a text and a few texts at a time, and their ids are parted where a piece with a space
begins, or at a rare sign put between them; where the parts are not as many as the chunks, one by one.

Where the vocabulary drops white space and case and parts a word from the sign after it (asked of it once, over all of
Latin-1), Latin-1 texts are lower-cased and cut there too, so that a word is one chunk whatever its case and the sign after
it. Words of letters are one piece each, and their ids are parted at those that end a piece.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

CACHE_ENTRIES = 300_000
SEEN = 1 << 23
CACHE_CHARS = 48
JOINED = 2_048
AT_ONCE = 16
_CUT = re.compile(r" (?=\S)")
_GAP = re.compile(r" \s")
_LINES = re.compile(r"\s\n|\n\s")
_CONTROL = re.compile("[\x1c-\x1f]")  # white space to Python, signs to the tokenizer
_SPACE = re.compile(r"\s")
_SIGN = re.compile(r"[!-/:-@\[-`{-~](?<=[^\W_].)")  # of ASCII, after a letter or a digit
_ENCODERS: dict[tuple[str, bool], "ChunkEncoder"] = {}


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the public_tokenizers package; pass any other path to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, keep_space: bool) -> "ChunkEncoder":
    """The worker's encoder for a vocabulary, made once per Python process."""
    key = (path, keep_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, keep_space)
    return _ENCODERS[key]


class ChunkEncoder:
    """encode(texts) -> one bytes of little-endian unsigned 32-bit ids per text.

    keep_space: the vocabulary's pieces carry their leading space (byte-level BPE). Otherwise white space is
    dropped by the tokenizer, and texts are cut at every space.
    folds: whether case and the place between a word and a sign after it make no difference in Latin-1 texts.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keep_space = keep_space
        self.first: dict[str, bytes] = {"": b""}
        self.rest: dict[str, bytes] = {"": b""}
        self.seen, self.marks = bytearray(SEEN), 0
        self.passing: list[tuple[dict[str, bytes], str]] = []
        self.folds, self.closes = False, None
        if keep_space:  # ids of pieces that begin with a space, which byte-level vocabularies write as this letter
            self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        else:
            single = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in "§¶¤¦†,"}
            self.sign, self.mark = next(((c, ids[0]) for c, ids in single.items() if len(ids) == 1), (None, -1))
            self.folds, self.closes = self._folds(), self._closes()

    def _folds(self) -> bool:
        """Whether every letter and digit of Latin-1 gives the same pieces with a sign of ASCII after it and, in lower case, parted from it."""
        own = self.tokenizer
        if own.normalizer is None or own.pre_tokenizer is None or not all(t.special for t in own.get_added_tokens_decoder().values()):
            return False
        pairs = [c + s for c in map(chr, range(256)) if c.isalnum() for s in map(chr, range(33, 127)) if not s.isalnum()]
        whole, parted = (own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(t)) for t in (" ".join(pairs), " ".join(_SIGN.sub(r" \g<0>", p.lower()) for p in pairs)))
        return [p for p, _ in whole] == [p for p, _ in parted] and len(whole) == 2 * len(pairs)

    def _closes(self) -> np.ndarray | None:
        """By id: whether it ends a piece. None if the vocabulary does not tell."""
        from tokenizers.pre_tokenizers import ByteLevel

        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix or not all(c + suffix in vocab for c in ByteLevel.alphabet()):
            return None
        closes = np.zeros(max(vocab.values()) + 1, bool)
        closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return closes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._cut(t or "") for t in texts]
        heads = [b""] * len(cut)
        if self.keep_space:
            self._learn(self.first, {c[0] for c in cut}, "")
            heads = [self.first[c[0]] for c in cut]
            for c in cut:
                c[0] = ""
        chunks: set[str] = set()
        for c in cut:
            chunks.update(c)
        self._learn(self.rest, chunks, " " if self.keep_space else "")
        known = self.rest.__getitem__
        out = [head + b"".join(map(known, c)) for head, c in zip(heads, cut)]
        self._trim()
        return out

    def _cut(self, text: str) -> list[str]:
        """The chunks of a text. One that begins with a line end has no space before it, all others but the first have."""
        if not self.keep_space:
            if self.folds and _latin(text):
                text = _SIGN.sub(r" \g<0>", text.lower())
            return text.split(" ") if _CONTROL.search(text) else text.split()
        if text[-1:] == " " or _GAP.search(text):
            return _CUT.split(text)
        if "\n" in text and not _LINES.search(text) and text[0] != "\n" != text[-1]:
            text = text.replace("\n", " \n")
        return text.split(" ")

    def _learn(self, known: dict[str, bytes], chunks: set[str], before: str) -> None:
        new = sorted(chunks.difference(known))
        self.passing += [(known, c) for c in new if len(c) > CACHE_CHARS or self._unseen(c)]
        if known is self.rest and self.closes is not None:
            self._join(known, [c for c in new if c.isalpha()], " ", self._closed)
            new = [c for c in new if c not in known]
        if known is self.rest and (self.keep_space or self.sign):
            plain = [c for c in new if not _SPACE.search(c) and (self.keep_space or self.sign not in c)]
            self._join(known, plain, " " if self.keep_space else f" {self.sign} ", self._opened if self.keep_space else self._marked)
            new = [c for c in new if c not in known]
        for i in range(0, len(new), JOINED):
            some = new[i : i + JOINED]
            for c, e in zip(some, self.tokenizer.encode_batch_fast([c if c[0] == "\n" else before + c for c in some], add_special_tokens=False)):
                ids = e.ids
                known[c] = struct.pack(f"<{len(ids)}I", *ids)

    def _unseen(self, chunk: str) -> bool:
        """Whether a chunk is new to the table, which then has it."""
        at = hash(chunk) % SEEN
        if self.seen[at]:
            return False
        if self.marks > SEEN // 2:
            self.seen, self.marks = bytearray(SEEN), 0
        self.seen[at], self.marks = 1, self.marks + 1
        return True

    def _join(self, known: dict[str, bytes], chunks: list[str], between: str, parts) -> None:
        """Encode chunks many in a text, and give each its ids where they can be told apart."""
        runs = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        for i in range(0, len(runs), AT_ONCE):
            some = runs[i : i + AT_ONCE]
            texts = [(" " if self.keep_space else "") + between.join(r) for r in some]
            for run, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                a = np.array(e.ids, "<u4")
                starts, ends = parts(a)
                if len(starts) == len(ends) == len(run):
                    raw = a.tobytes()
                    known.update((c, raw[x:y]) for c, x, y in zip(run, (4 * starts).tolist(), (4 * ends).tolist()))

    def _opened(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(self.opens[a])
        return starts, np.append(starts[1:], len(a))

    def _marked(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = np.flatnonzero(a == self.mark)
        return np.append(0, marks + 1), np.append(marks, len(a))

    def _closed(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(self.closes[a]) + 1
        return np.append(0, ends[:-1]), ends

    def _trim(self) -> None:
        for known, c in self.passing:
            del known[c]
        self.passing.clear()
        for known in (self.first, self.rest):
            if len(known) > CACHE_ENTRIES:
                known.clear()
                known[""] = b""


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(batches, rows: int = 512):
    """Arrow batches in pieces of so many rows, so that few texts are held as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(texts: list[str | None], chars: int = 1_000_000):
    """Runs of rows of about so many characters, to bound what is held at once."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
