"""SentencePiece BPE by a prefix table, without merging whole texts.

For merge-type BPE the encoding of a string is the one sequence of pieces in which every two neighbours
are compatible: the two of them, concatenated, encode to themselves. So every prefix has exactly one last piece.
An Aho-Corasick automaton lists the pieces that end at each position; a candidate is the prefix's last
piece if it is compatible with the last piece of the prefix that remains before it. Ids are then recovered
backwards from the table. Characters that no piece has are symbols of their own, compatible with all, and become byte pieces.

Pieces never continue past a space mark (checked on loading), so a text falls into chunks that start at a
space mark; a bounded memo keeps what recent chunks encode to. Ids are decoded from the whole list that encoding gives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE = "▁"
#: Chunks that the memo holds before it is emptied (some 200 MB).
MEMO = 600_000
#: Tested pairs that are remembered before the memory is emptied (some 100 MB).
MEMO_PAIRS = 1_000_000
#: Longer chunks are not kept.
MEMO_CHARS = 64


class PrefixTable:
    """Encoder and decoder equal to the library's for BPE models with byte fallback and the identity normaliser."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes = {}
        self.rank: dict[str, tuple[float, int]] = {}
        self.text: list[str] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if not sp.is_byte(i):
                piece = piece.replace(SPACE, " ")
            self.text.append(piece)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[piece] = (-sp.get_score(i), i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if any(sp.normalize(s) != want for s, want in (("a", f"{SPACE}a"), (" a  b ", f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}"), ("Åﬁ", f"{SPACE}Åﬁ"))):
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        if any(" " in p.lstrip(" ") for p in self.rank):
            raise ValueError("a piece continues past a space mark")
        #: The two pieces whose merge makes a piece; a single character has none.
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            parts = self.merged(piece, last=True)
            if len(piece) > 1:
                if len(parts) != 2:  # never made by merging: it ends no prefix
                    continue
                self.halves[i] = (self.rank[parts[0]][1], self.rank[parts[1]][1])
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: What an id decodes to on its own, as an ASCII byte does among any others; None for other bytes, controls and the unknown id.
        self.plain = [None if i in self.byte_of or i in self.control or i == self.unknown else t for i, t in enumerate(self.text)]
        for b in range(128):
            self.plain[self.bytes[b]] = chr(b)
        self.memo: dict[str, tuple[int, ...]] = {}
        #: Ids as decimal text.
        self.digits = [str(i) for i in range(n)]

    def merged(self, text: str, last: bool = False) -> list[str]:
        """BPE by its definition: the best adjacent pair first, of equal ones the leftmost.

        For short strings. last: stop before the merge that would make the whole string.
        """
        parts = list(text)
        rank = self.rank
        while len(parts) > 2 - (not last):
            best = None
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best[0]):
                    best = (r[0], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the concatenation of two pieces encodes to just them.

        Undoes the merges of both pieces, latest first, and looks whether an earlier merge could have
        joined the two parts that touch. Of equal ranks the leftmost merge comes first.
        """
        score, text, halves = self.rank, self.text, self.halves
        limit = (float("inf"), 0)
        while True:
            joined = score.get(text[a] + text[b])
            if joined is not None and (joined[0], 1) < limit:
                return False
            left, right = (score[text[a]][0], 0), (score[text[b]][0], 2)
            if a not in halves and b not in halves:
                return True
            if b not in halves or (a in halves and left[0] > right[0]):
                limit, a = (left[0], 1), halves[a][1]
            else:
                limit, b = right, halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def ids_of(self, text: str) -> list[int]:
        """Ids of a normalised string, by the prefix table."""
        n = len(text)
        last, size = [-1] * n, [1] * n  # -1: a character that no piece has
        pairs = self.pairs.get
        for end, (piece, length) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            at = end - length
            if at >= 0 and (before := last[at]) >= 0:
                known = pairs(before << 20 | piece)
                if not (self.compatible(before, piece) if known is None else known):
                    continue
            last[end], size[end] = piece, length
        ids: list[int] = []
        end = n - 1
        while end >= 0:
            if last[end] >= 0:
                ids.append(last[end])
            else:
                ids += [self.bytes[b] for b in reversed(text[end].encode())]
            end -= size[end]
        ids.reverse()
        return ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text after normalising: each is a run of spaces and what follows up to the next.

        Normalising makes a space mark of each space and puts one in front. A space stands for the mark here, so that texts of
        Latin letters take one byte a character; a mark in the text is the same thing to the model.
        """
        if not text:
            return []
        return _CHUNK.findall(" " + text.replace(SPACE, " "))

    def coded(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk."""
        known = self.memo.get(chunk)
        if known is None:
            known = tuple(self.ids_of(chunk))
            if len(chunk) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = known
        return known

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        found = list(map(self.memo.get, chunks))
        if None in found:
            found = [ids or self.coded(c) for c, ids in zip(chunks, found)]
        return list(chain.from_iterable(found))

    def raw_decode(self, ids: list[int]) -> str:
        """The text of ids with the dummy prefix still on it."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # bytes of longer characters, controls or the unknown id
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.control:
                continue
            out.append(" ⁇ " if i == self.unknown else self.text[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.control), self.unknown)
        text = self.raw_decode(ids)
        return text[1:] if self.text[first].startswith(" ") else text


def _utf8(raw: bytes) -> str:
    """Valid characters as they are, every other byte as U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_CHUNK = re.compile(" +[^ ]*|[^ ]+")
_LOADED: dict[str, PrefixTable] = {}


def loaded(model_file: str) -> PrefixTable:
    """One table per worker process and model."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PrefixTable(model_file)
    return _LOADED[model_file]


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array, if asked for), n_tokens, ids_sha256 and decoded_sha256 of every row; null texts count as empty.

    An empty text has no ids. The digests are of the decimal ids joined by commas, and of the text decoded from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(model_file)
        digits = table.digits.__getitem__
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = table.encode(text)
                back = table.decode(ids)
                row = (len(ids), hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                rows.append((*row, ids) if with_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if with_ids else [])]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text decoded from the ids column; null ids give an empty text.

    The unknown id, which encoding never gives, is decoded as " ⁇ "; the library spells it by its neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([table.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {kind}, text string")
