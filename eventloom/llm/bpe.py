"""Byte-pair encoding and decoding by a tokenization automaton.

Compilation starts from one state with an arc for every byte, and adds one gadget for each merge (u, v), in order: the
state that u leads to loses its arc v (u followed by v would have been merged), and states with an arc u get an arc uv.
An arc's label alone decides the state it leads to, so a state is named by the last token. The result accepts exactly one
token sequence for each byte string: the one that the merges give. Written out, the automaton of 50,000 merges has some
10^9 arcs; so the gadgets are kept as tables of two parts and a rank for each token, and whether state t has an arc u is
found by undoing the gadgets of the two tokens in rank order, once, and kept in the transition table.

A word is encoded by running the automaton over its bytes, with the longest arc first and a step back where no arc leads on;
as the automaton accepts one sequence only, whatever reaches the end is it. Words are pre-split by the tokenizer's own pattern; added tokens are found first. Decoding emits the bytes that label each arc.

The tokenizer file is named by a path and read on each executor. Null and empty text: no tokens, sha256 of nothing. Texts of
any length are run whole; repeated rows stay; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import map_batches, table

WORDS_KEPT, ARCS_KEPT = 400_000, 500_000  # entries after which a table is emptied: bounds of memory, not of results
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def _pattern(letter: str, number: str) -> str:
    """The byte-level pre-split pattern (a fixed value) with the white space of Unicode written out."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


SPLIT = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
#: Texts of these characters are split by the standard library with the same classes written out: it is faster.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
PLAIN = re.compile(rf"[\x00-\x7f{_LATIN}]*")
PLAIN_SPLIT = re.compile(_pattern(_LATIN, "0-9"))


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Words(dict):
    """Tokens by word; a missing word is run, and kept if it is short."""

    def __init__(self, run):
        self.run = run

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(self.run(word.encode()))
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = got
        return got


class Automaton:
    """Encoder and decoder compiled from a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items() if s not in self.added}
        self.token = {b: i for i, b in self.label.items()}
        self.label |= {i: s.encode() for s, i in self.added.items()}
        #: gadgets: merged token -> (rank, left, right); (left, right) -> rank
        self.made: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((u, v), r)
            self.made.setdefault(w, (r, u, v))
        self.token = {b: i for b, i in self.token.items() if (len(b) == 1 or i in self.made) and self._sound(i)}
        #: the lengths, longest first, of the tokens with these first four bytes
        lengths: dict[bytes, set[int]] = {}
        for b in self.token:
            if len(b) >= 4:
                lengths.setdefault(b[:4], set()).add(len(b))
        self.lengths = {b: tuple(sorted(n, reverse=True)) for b, n in lengths.items()}
        self.size = {i: len(b) for b, i in self.token.items()}
        #: the longest token that begins a token and isn't it
        self.shorter: dict[int, int] = {}
        for b, i in self.token.items():
            for k in range(len(b) - 1, 0, -1):
                if b[:k] in self.token:
                    self.shorter[i] = self.token[b[:k]]
                    break
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self.run)
        self.find_added = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None

    def _has_arc(self, left: int, right: int, before: int = sys.maxsize) -> bool:
        """Whether state ``left`` keeps an arc ``right`` after the gadgets up to rank ``before``.

        Undo gadgets from the last on: the token whose gadget came later is opened at the border. If the two that then
        meet have a gadget of their own that came sooner, they would have merged: no arc. Of equal ranks the left place
        merges first, so the right token is opened first, and a gadget of just that rank counts as sooner.
        """
        rank, made = self.rank, self.made
        while True:
            if rank.get((left, right), sys.maxsize) < before:
                return False
            a, b = made.get(left), made.get(right)
            if a is not None and (b is None or a[0] > b[0]):
                before, left = a[0], a[2]
            elif b is not None:
                before, right = b[0] + 1, b[1]
            else:
                return True

    def _sound(self, t: int) -> bool:
        """Whether the merges make token ``t`` of its own bytes; others label no arc."""
        m = self.made.get(t)
        return m is None or (self._sound(m[1]) and self._sound(m[2]) and self._has_arc(m[1], m[2], m[0]))

    def run(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: the longest arc first, back one token where none leads on."""
        if (whole := self.token.get(word)) is not None:
            return [whole]
        token, arcs, shorter, size = self.token, self.arcs, self.shorter, self.size
        n, at, out = len(word), 0, []
        dead: set[int] = set()  # places from which the end can't be reached with what stands before them
        t = self._longest(word, 0)
        while at < n:
            while t is not None:
                if at + size[t] not in dead:
                    if not out:
                        break
                    key = (out[-1], t)
                    ok = arcs.get(key)
                    if ok is None:
                        if len(arcs) >= ARCS_KEPT:
                            arcs.clear()
                        ok = arcs[key] = self._has_arc(*key)
                    if ok:
                        break
                t = shorter.get(t)
            if t is None:
                dead.add(at)
                t = out.pop()
                at -= size[t]
                t = shorter.get(t)
                continue
            out.append(t)
            at += size[t]
            t = self._longest(word, at) if at < n else None
        return out

    def _longest(self, word: bytes, at: int) -> int:
        """The longest token that the bytes from ``at`` on begin with."""
        get, head = self.token.get, word[at : at + 4]
        for k in self.lengths.get(head, ()):
            if (t := get(word[at : at + k])) is not None:
                return t
        for k in (3, 2, 1):
            if (t := get(head[:k])) is not None:
                return t
        raise ValueError("a byte without a token")

    def encode(self, text: str) -> array:
        ids = array("I")
        at = 0
        for m in self.find_added.finditer(text) if self.find_added and any(a in text for a in self.added) else ():
            self._ordinary(text[at : m.start()], ids)
            ids.append(self.added[m[0]])
            at = m.end()
        self._ordinary(text[at:] if at else text, ids)
        return ids

    def _ordinary(self, text: str, ids: array) -> None:
        ids.extend(chain.from_iterable(map(self.words.__getitem__, (PLAIN_SPLIT if PLAIN.fullmatch(text) else SPLIT).findall(text))))

    def forget(self) -> None:
        """Empty the tables that grow with the texts."""
        self.words.clear()
        self.arcs.clear()

    def decode(self, ids) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_BUILT: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a file, built once in a process."""
    if path not in _BUILT:
        _BUILT[path] = Automaton(path)
    return _BUILT[path]


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also the ids themselves."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        engine = automaton(path)
        n, a, b, all_ids = [], [], [], []
        for text in batch.column(1):
            got = engine.encode(text.as_py() or "")
            raw = got if sys.byteorder == "little" else array("I", got).byteswap() or got
            n.append(len(got))
            a.append(hashlib.sha256(raw.tobytes()).hexdigest())
            b.append(hashlib.sha256(engine.decode(got).encode()).hexdigest())
            if ids:
                all_ids.append(list(got))
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        return pa.RecordBatch.from_arrays(cols + ([pa.array(all_ids, pa.list_(pa.int32()))] if ids else []), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, lambda: automaton(path).forget())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), default_path())


def bpe_round_trip(spark, sf_dir):
    """The part of op8 that SQL can express: the decoded text is the text."""
    return op8_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


BPE_ROUND_TRIP_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"
