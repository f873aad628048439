"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is split at spaces and at neighbouring characters that stand together in no piece (no merge can cross them).
Each part is encoded by a score-ordered agenda of adjacent symbol pairs: the best-scored pair whose joined text is a
piece is merged first, the leftmost on a tie, and its two new neighbour pairs enter the agenda.  Symbols that are no
piece fall back to byte pieces.  Decoding joins pieces, turns runs of byte pieces into UTF-8 (U+FFFD for bad bytes) and
``U+2581`` into spaces, less the one put in front.

Each Arrow batch checks the parts it met first against the sentencepiece library and fails on any difference.

Defined results: null text is empty; an empty text has no ids and decodes to the empty text; equal rows are separate
documents; an empty table gives no rows; other columns pass through :func:`encode_decode`.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import documents, slices

SPACE = "▁"
CACHE_PARTS = 300_000      # parts remembered in a worker; beyond it the memory starts anew (speed only)
SHORT_PART = 64            # up to here the agenda is a list, beyond it a heap; both give the same merges
NO_PIECE = float("inf")
LONG_PART = 64             # longer parts aren't remembered


class Memory(dict):
    """Remembers ``of(key)``; starts anew when full."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) >= CACHE_PARTS:
            self.clear()
        got = self[key] = self.of(key)
        return got


class PieceModel:
    """Vocabulary, agenda encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.byte_of = {i: int(t[3:5], 16) for i, t in enumerate(self.text) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.unknown = lib.unk_id()
        own = [i for i in range(len(self.text)) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.special = {i for i in range(len(self.text)) if lib.is_control(i) or lib.is_unknown(i)}
        self.id_of = {self.text[i]: i for i in own}
        self.cost = {self.text[i]: -lib.get_score(i) for i in own}
        self.plain = frozenset(own)
        self.joins = {t[k:k + 2] for t in self.id_of for k in range(len(t) - 1)}
        if any(SPACE in t.lstrip(SPACE) for t in self.id_of):
            raise ValueError("a piece spans two words; this encoder splits at spaces")
        self.parts = Memory(self._part)
        self.whole = Memory(lambda w: self._word(SPACE + w))
        self.fresh: list[tuple[str, str]] = []

    def agenda(self, part: str) -> list[int]:
        """Ids of one part by the score-ordered agenda of adjacent pairs."""
        sym = self._merged_short(part) if len(part) <= SHORT_PART else self._merged_long(part)
        out: list[int] = []
        for s in sym:
            i = self.id_of.get(s)
            out += [i] if i is not None else [self.byte_id[b] for b in s.encode("utf-8")] if self.byte_id else [self.unknown]
        return out

    def _merged_short(self, part: str) -> list[str]:
        """Agenda as a plain list of costs in text order: the least cost, leftmost on a tie, is merged."""
        cost, none = self.cost.get, NO_PIECE
        sym = list(part)
        pair = list(map(add, sym, sym[1:]))
        todo = [cost(p, none) for p in pair]
        while todo:
            least = min(todo)
            if least == none:
                break
            i = todo.index(least)
            sym[i] = pair[i]
            del sym[i + 1], pair[i], todo[i]
            if i < len(todo):
                pair[i] = p = sym[i] + sym[i + 1]
                todo[i] = cost(p, none)
            if i:
                pair[i - 1] = p = sym[i - 1] + sym[i]
                todo[i - 1] = cost(p, none)
        return sym

    def _merged_long(self, part: str) -> list[str]:
        """Agenda as a heap over linked symbols, for parts of any length."""
        cost, n = self.cost, len(part)
        sym = list(part)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        todo = []

        def offer(i: int, j: int) -> None:
            joined = sym[i] + sym[j]
            c = cost.get(joined)
            if c is not None:
                heapq.heappush(todo, (c, i, j, joined))
        for i in range(n - 1):
            offer(i, i + 1)
        while todo:
            _, i, j, joined = heapq.heappop(todo)
            if not sym[i] or not sym[j] or nxt[i] != j or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, ""
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                offer(i, k)
            if prev[i] >= 0:
                offer(prev[i], i)
        return [s for s in sym if s]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte runs as UTF-8; the caller takes off the leading space."""
        if self.plain.issuperset(ids):
            return "".join([self.text[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append("" if i in self.special and i != self.unknown else " ⁇ " if i == self.unknown else self.text[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _part(self, part: str) -> tuple[str, str]:
        got = self.agenda(part)
        ids, text = ",".join(map(str, got)), self.decode(got)
        self.fresh.append((part, ids))
        return ids, part if text == part else text

    def _word(self, word: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of one word with its leading spaces."""
        joins, parts = self.joins, self.parts
        cuts = [k for k, p in enumerate(map(add, word, word[1:]), 1) if p not in joins]
        if not cuts:
            return parts[word] if len(word) <= LONG_PART else self._part(word)
        got = [parts[p] if len(p) <= LONG_PART else self._part(p)
               for p in [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]]
        return ",".join([g[0] for g in got]), "".join([g[1] for g in got])

    def encode_decode(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text)."""
        if not text:
            return "", ""
        whole = self.whole
        words = text.replace(" ", SPACE).split(SPACE)
        if "" in words:   # words keep the spaces before them; one space is put in front of the text
            words = self._spaced(words)
            got = [whole[w[1:]] if 1 < len(w) <= LONG_PART else self._word(w) for w in words]
        elif len(max(words, key=len)) < LONG_PART:
            got = [whole[w] for w in words]
        else:
            got = [whole[w] if len(w) < LONG_PART else self._word(SPACE + w) for w in words]
        return ",".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]

    @staticmethod
    def _spaced(words: list[str]) -> list[str]:
        """Words with the spaces before them (as U+2581); spaces at the end stand alone."""
        out, lead = [], ""
        for w in words:
            lead += SPACE
            if w:
                out.append(lead + w)
                lead = ""
        return [*out, lead] if lead else out

    def check(self) -> None:
        """Compare the parts met since the last call with the library; the first part of a text carries its own space."""
        fresh, self.fresh = self.fresh, []
        plain = [(p, i) for p, i in fresh if p.startswith(SPACE)]
        other = [(p, i) for p, i in fresh if not p.startswith(SPACE)]
        if plain:  # the library puts one space in front by itself
            got = self.library.encode([p[1:] for p, _ in plain], num_threads=1)
            got = [g if p != SPACE else [self.id_of[SPACE]] for (p, _), g in zip(plain, got)]
            self._same(plain, got)
        if other:  # a line feed joins with nothing, so what follows it is encoded as if alone
            lead = self.library.encode("\n", num_threads=1)
            got = self.library.encode(["\n" + p for p, _ in other], num_threads=1)
            if self._splits("\n"):
                self._same(other, [g[len(lead):] for g in got])

    def _splits(self, c: str) -> bool:
        return not any(c in j for j in self.joins)

    @staticmethod
    def _same(parts, got) -> None:
        for (p, i), g in zip(parts, got):
            if i != ",".join(map(str, g)):
                raise ValueError(f"encoding of {p!r} differs from the library: {i} and {g}")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the operator's outputs.

    Either ``piece_ids`` (array<int>) and ``piece_text``, or with ``digests`` ``n_tokens, ids_sha256, decoded_sha256``.
    """
    keep = docs.columns if keep is None else keep
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["piece_ids", "piece_text"]
    keep = [c for c in keep if c not in new]
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__pc_text"))
    types = [T.LongType(), T.StringType(), T.StringType()] if digests else [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, t) for n, t in zip(new, types)])

    def run(batches):
        m = model(model_path)
        for b in slices(batches, "__pc_text", 1 << 20):
            got = [m.encode_decode(t or "") for t in b.column("__pc_text").to_pylist()]
            m.check()
            if digests:
                cols = [pa.array([i.count(",") + 1 if i else 0 for i, _ in got], pa.int64()),
                        pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in got], pa.string()),
                        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for _, t in got], pa.string())]
            else:
                n = [i.count(",") + 1 if i else 0 for i, _ in got]
                flat = np.array(",".join([i for i, _ in got if i]).split(",") if any(n) else [], np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat)),
                        pa.array([t for _, t in got], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, names=[*keep, *new])
    return src.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    return encode_decode(documents(spark, sf_dir), model_path or default_model(), digests=True, keep=["doc_id"])
