"""Exact batch tokenisation with a public tokenizer file, shared by the token operators.

A byte-level BPE pre-tokenizer never joins characters across a blank that stands between two
non-blank characters: the token before it ends there and the next one starts with that blank. Such
blanks are *safe boundaries*. Texts of any length are cut there into pieces, Arrow numbers a batch's distinct
pieces, and only those that the worker does not remember are encoded by the library, in groups balanced
by bytes. A text's tokens are its pieces' tokens in order, so results equal encoding it whole
(special strings contain no blank and stay inside one piece). A text without a safe boundary is
one piece.

What is said of byte-level BPE is checked against the tokenizer file. Files of any other kind, sentencepiece
models (.model) among them, are given whole texts, in batches balanced by bytes.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .worker import give_back, held

TOKENIZER = "byte_bpe_50k.json"
MEMO_PIECES = 300_000  # bound on what a worker remembers: two halves, of which the older goes when the newer is full
GROUP_BYTES = 1 << 16  # length of a joined text
BATCH_BYTES = 4 << 20  # text handled at once

_BLANK = "\u0120"  # how byte-level vocabularies write a blank
# ASCII white space but blank and newline; how the other white space starts in UTF-8
_RARE = bytes([*range(9, 10), *range(11, 14), *range(28, 32)])
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
# how byte-level vocabularies write the bytes (given as characters 0-255): printing ones as they are, the others from 256 on
_PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTING)}
# pieces without white space but single line breaks and without apostrophes (which may join letters), and their parts
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_INK = rf"[{_LETTERS}0-9!-&(-/:-@\[-`{{-~]+"
_PARTED = re.compile(rf"{_INK}(?:\n{_INK})*")
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]+|\n|[^{_LETTERS}0-9\n]+")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file (the path is a parameter of every operator)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: str) -> bool:
    """Every blank stands between characters that are no white space (at the ends of the text also alone)."""
    if "  " in text or " \n" in text or "\n " in text:
        return False
    raw = text.encode()
    return len(raw.translate(None, _RARE)) == len(raw) and not any(w in raw for w in (_WIDE if not text.isascii() else ()))


def split_safe(text: str) -> list[str]:
    """The text cut at its safe boundaries; the blank in front of every piece but the first is left out."""
    if _plain(text):
        return text.split(" ")
    first, *rest = _SAFE.split(text)
    return [first, *(p[1:] for p in rest)]


def by_bytes(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Consecutive groups of about `limit` bytes; a longer text ends the group it is in."""
    ends = np.cumsum(np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts)))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit)) + 1
        yield texts[a:b]
        a = b


def is_plain_byte_level(path: str) -> bool:
    """Whether a tokenizer file is byte-level BPE of the kind that safe boundaries and joined pieces hold for."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    special = [t for t in spec.get("added_tokens") or () if any(c.isspace() for c in t["content"]) or t.get("lstrip")
               or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(k) for k in odd)
            and not special)


class WholeEncoder:
    """Encodes whole texts with the file's library, in batches balanced by bytes."""

    def __init__(self, path: str, kind: str):
        self.kind = kind
        if path.endswith(".model"):
            import sentencepiece

            tok = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: tok.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.batch = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def values(self, texts: list[str]) -> Iterator:
        for group in by_bytes(texts, BATCH_BYTES):
            for ids in self.batch(group):
                yield len(ids) if self.kind == "count" else _packed(ids)


class Encoder:
    """Encodes pieces once and remembers a bounded number of them, each as its `count` or its `ids`."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.kind = self.tok.model, kind
        self.form, self.form_one = (_counts, len) if kind == "count" else (_bytes, _packed)
        self.new, self.old = {}, {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, lead: str, word: str):
        """The value of a single pre-token."""
        if not word.isascii() or word == "\n":
            word = word.encode().decode("latin-1").translate(_WRITTEN)
        return self.form_one([t.id for t in self.model.tokenize(lead + word)])

    def _value(self, piece: str):
        """The value of a piece, or none if only the library can tell it. A piece that starts with a blank is the
        start of a text, written behind that blank; before any other piece stands a blank of the text."""
        if (value := self.new.get(piece)) is None:
            if (value := self.old.get(piece)) is None and (value := self._make(piece)) is None:
                return None
            self.new[piece] = value
        return value

    def _make(self, piece: str):
        """A piece of Latin letters, digits, marks and single line breaks is put together from these: a token never spans
        two kinds, so counts add up and ids follow each other."""
        lead, word = ("", piece[1:]) if piece[:1] == " " else (_BLANK, piece)
        if word.isascii() and word.isalpha() or word == "\n" and not lead:
            return self._one(lead, word)
        if not _PARTED.fullmatch(word) or any(t in word for t in self.special):
            return None
        first, *more = _PARTS.findall(word)
        if not more:
            return self._one(lead, word)
        value = self._value(first if lead else " " + first)
        for part in more:
            value += self._value(" " + part)
        return value

    def _of_pieces(self, pieces: list[str]) -> list:
        """Values of distinct pieces, in their order."""
        if len(self.new) > MEMO_PIECES // 2:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, pieces))
        rest, value = [], self._value
        for k in [k for k, v in enumerate(found) if v is None]:
            if (v := value(pieces[k])) is None:
                rest.append(k)
            else:
                found[k] = v
        texts = [pieces[k][1:] if pieces[k][:1] == " " else " " + pieces[k] for k in rest]
        for group in by_bytes(texts, GROUP_BYTES):
            ids = self._encode(group)
            for k, v in zip(rest, self.form(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))):
                self.new[pieces[k]] = found[k] = v
            rest = rest[len(group):]
        return found

    def values(self, texts: list[str]) -> Iterator:
        """Per text its number of tokens, or its ids as little-endian unsigned 32-bit integers."""
        for group in by_bytes(texts, BATCH_BYTES):
            coded, order, ends, firsts = self._cut(group)
            names = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy().copy()
            heads = {" " + f: len(names) + k for k, f in enumerate(dict.fromkeys(firsts))}  # no other piece starts with a blank
            codes[ends[:-1]] = [heads[" " + f] for f in firsts]
            collecting = gc.isenabled()
            gc.disable()  # many small objects come and none goes in circles
            try:
                found = self._of_pieces([*names, *heads])
            finally:
                if collecting:
                    gc.enable()
            if self.kind == "count":
                sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[codes])])
                out = np.diff(sums[ends]).tolist()
            else:
                laid = pa.array(found, pa.large_binary()).take(pa.array(codes))
                at = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[ends].tolist()
                raw = laid.buffers()[2].to_pybytes() if at[-1] else b""
                out = [raw[a:b] for a, b in zip(at, at[1:])]
            yield from map(out.__getitem__, order)
            del coded, names, codes, found
        give_back()

    def _cut(self, texts: list[str]):
        """The numbered pieces of texts, plain ones (cut by Arrow) first: (pieces, each text's place, where texts' pieces
        start, the texts' first pieces)."""
        plain = [_plain(t) for t in texts]
        lists = pc.split_pattern(pa.array([t for t, x in zip(texts, plain) if x], pa.string()), " ")
        rest = [split_safe(t) for t, x in zip(texts, plain) if not x]
        parts = [lists.flatten(), pa.array([p for r in rest for p in r], pa.string())]
        sizes = np.concatenate([np.diff(lists.offsets.to_numpy()), np.array([len(r) for r in rest], np.int64)])
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        pieces = pa.concat_arrays(parts)
        place, at = [], [0, len(lists)]
        for x in plain:
            place.append(at[not x])
            at[not x] += 1
        return pieces.dictionary_encode(), place, ends, pieces.take(pa.array(ends[:-1])).to_pylist()


def _counts(ids: np.ndarray, at: np.ndarray) -> list[int]:
    return np.diff(at).tolist()


def _bytes(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw, cut = ids.astype("<u4").tobytes(), (4 * at).tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # little-endian on every platform that Spark runs on


def encoder(path: str, kind: str):
    """The worker's encoder for a file: `count` gives lengths, `ids` little-endian unsigned 32-bit ids."""
    plain = lambda: path.endswith(".json") and is_plain_byte_level(path)
    return held(("tokens", path, kind), lambda: (Encoder if plain() else WholeEncoder)(path, kind))
