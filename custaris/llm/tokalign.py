"""Cross-tokenizer alignment: whitespace-token anchors.

Each text is tokenised whole by both vocabularies: a byte-level one (A) on space + text, a piece vocabulary (B) on the text,
which puts that space in front by itself.  A token's end is the sum of the byte lengths so far; both sums run over the same
bytes, which is checked.  An anchor is an end that both share before tokens that both begin with a space: anchors split a
document into windows of token ids.  A window's alignment (its groups, cut at shared ends, and its links) depends on its two
id tuples alone, so it is found once and remembered under them.

A link is a pair of tokens that end together.  ``pair_counts`` counts links of each id pair over the corpus and marks the
pairs that are the most counted ones of their B id; ``scores`` gives each document its links' counts.  The ``COMMON_PAIRS``
commonest pairs are broadcast (at most that many rows of two numbers), all others are joined by shuffle: none of them can
hold more than its share of the links, so no key is hot.

Very long texts are tokenised in segments, cut at single spaces between other characters, where no token of either
vocabulary can cross; a text without such spaces is one segment.

Defined results: null and empty texts, and texts whose A or B bytes differ from space + text (those with U+2581, for
example), have no tokens; equal rows are separate rows, and count as often; ties for the highest count are all best; an
empty table gives no rows; own columns named like a result give way to it.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialize, slices

SPACE = "▁"
SEGMENT = 1 << 18          # characters from which a text is cut at the next safe space
COMMON_PAIRS = 1 << 18     # id pairs broadcast at most
REMEMBERED = 100_000       # windows remembered in a worker; beyond it the memory starts anew (speed only)
LONG_WINDOW = 32           # tokens beyond which a window isn't remembered
CHECKED = 20_000           # characters of the text that each batch checks against the tokenizers library, at most
RESULTS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two vocabularies and the alignments found so far in this worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task keeps to its core
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        spec = json.load(open(a_path, encoding="utf-8"))
        special = {t["id"] for t in spec.get("added_tokens", ())}
        alphabet = _byte_of()
        entries = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in entries.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_b = self.b.get_piece_size()
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b_bytes = []
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else
                                b"" if self.b.is_control(i) else piece.replace(SPACE, " ").encode())
        self.a_len, self.b_len = (np.array([len(t) for t in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([t[:1] == b" " for t in v]) for v in (self.a_bytes, self.b_bytes))
        n = max(len(self.a_bytes), self.n_b)
        self.digits = np.array([list(str(i).encode().rjust(len(str(n)), b"\0")) for i in range(n)], np.uint8)
        self.known: dict = {}

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both vocabularies, or None where they don't spell space + text."""
        if not text:
            return None
        parts = segments(text) if len(text) > SEGMENT else [text]
        a, b = self.a.encode_ordinary(" " + parts[0]), self.b.encode(parts[0], num_threads=1)
        for p in parts[1:]:
            a += self.a.encode_ordinary(" " + p)
            b += self.b.encode(p, num_threads=1)
        whole = b" " + text.encode("utf-8", "surrogatepass")
        of_a, of_b = self.a_bytes, self.b_bytes
        if b"".join([of_b[i] for i in b]) != whole or b"".join([of_a[i] for i in a]) != whole:
            return None
        return a, b

    def check(self, text: str, a: list[int]) -> None:
        got = self.library.encode(" " + text, add_special_tokens=False).ids
        if got != a:
            raise ValueError(f"tokens of {text[:80]!r}... differ from the tokenizers library")

    def windows(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray):
        """Windows of tokenised documents laid end to end; ``ends``: the documents' byte ends.

        Gives (document and kind of each window, and for each kind its alignment: groups as text, links as bytes of
        64-bit numbers ``a * n_b + b``).
        """
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        at_a, at_b, last = (np.zeros(int(end_a[-1]) + 1, bool) for _ in range(3))
        at_a[end_a], at_b[end_b], last[ends] = True, True, True
        # ends that both share; the tokens after them begin with a space on both sides, or the document is over
        hit_a, hit_b = np.flatnonzero(at_b[end_a]), np.flatnonzero(at_a[end_b])
        spaced = self.a_space[a[np.minimum(hit_a + 1, len(a) - 1)]] & self.b_space[b[np.minimum(hit_b + 1, len(b) - 1)]]
        anchor = np.flatnonzero(spaced | last[end_a[hit_a]])
        doc = np.searchsorted(ends, end_a[hit_a[anchor]])
        to_a, to_b = hit_a[anchor] + 1, hit_b[anchor] + 1
        from_a, from_b = _starts(to_a), _starts(to_b)
        kind, first = _kinds((a, from_a, to_a), (b, from_b, to_b))
        found: list = [None] * len(first)
        unknown, keys = [], []
        a32, b32 = a.astype(np.int32), b.astype(np.int32)
        for k, (fa, ta, fb, tb) in enumerate(zip(from_a[first].tolist(), to_a[first].tolist(), from_b[first].tolist(), to_b[first].tolist())):
            key = (a32[fa:ta].tobytes(), b32[fb:tb].tobytes())
            found[k] = self.known.get(key)
            if found[k] is None:
                unknown.append(k)
                keys.append(key)
        if unknown:
            w = first[unknown]
            groups = (_starts(anchor + 1)[w], anchor[w] + 1)
            texts = self._spelled(a, b, hit_a, hit_b, *groups)
            links = a[hit_a] * self.n_b + b[hit_b]
            for k, key, text, lo, hi in zip(unknown, keys, texts, groups[0].tolist(), groups[1].tolist()):
                found[k] = got = text, links[lo:hi].tobytes()
                if len(key[0]) + len(key[1]) <= LONG_WINDOW * 4:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[key] = got
        return doc, kind, found

    def _spelled(self, a, b, hit_a, hit_b, lo, hi) -> list[str]:
        """Groups of windows as text; a window has the groups ``lo`` to ``hi``, and a group ends at a shared end."""
        g = _ranges(lo, hi)
        from_a, from_b = _starts(hit_a + 1)[g], _starts(hit_b + 1)[g]
        n_a, n_b = hit_a[g] + 1 - from_a, hit_b[g] + 1 - from_b
        # the tokens in the order of the text, each followed by its mark
        at = np.cumsum(n_a + n_b)
        ids, mark = np.empty(int(at[-1]), np.int64), np.full(int(at[-1]), ord(","), np.uint8)
        start = _starts(at)
        ids[_ranges(start, start + n_a)] = a[_ranges(from_a, from_a + n_a)]
        ids[_ranges(start + n_a, at)] = b[_ranges(from_b, from_b + n_b)]
        mark[start + n_a - 1], mark[at - 1] = ord("|"), ord(";")
        chars = np.concatenate([self.digits[ids], mark[:, None]], 1)
        text = chars[chars > 0].tobytes().decode()
        size = np.cumsum((self.digits[ids] > 0).sum(1) + 1)
        stop = size[at[np.cumsum(hi - lo) - 1] - 1].tolist()
        return [text[x:y - 1] for x, y in zip([0, *stop], stop)]


def _starts(stops: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], stops[:-1]])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of ``lo`` to ``hi``, range after range."""
    n = hi - lo
    return np.repeat(lo - _starts(np.cumsum(n)), n) + np.arange(int(n.sum()))


def _kinds(*sides) -> tuple[np.ndarray, np.ndarray]:
    """(kind of each window, a window of each kind): windows of equal id tuples on both sides are one kind.

    Found by a hash of the tuples; then every window is compared with the one that stands for its kind.
    """
    h = np.zeros(len(sides[0][1]), np.uint64)
    for ids, lo, hi in sides:
        place = np.arange(len(ids)) - np.repeat(lo, hi - lo)
        h = _mixed(h, np.add.reduceat((ids + 1).astype(np.uint64) * _POWERS[place % len(_POWERS)], lo))
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    kind = kind.ravel()
    for ids, lo, hi in sides:
        twin = first[kind]
        if (hi - lo != (hi - lo)[twin]).any() or (ids[_ranges(lo[twin], hi[twin])] != ids).any():
            seen: dict = {}  # two tuples fell together: compare the tuples themselves
            kind = np.array([seen.setdefault(tuple(ids[x:y].tobytes() for ids, x, y in w), len(seen)) for w in zip(
                *[zip([ids] * len(lo), lo.tolist(), hi.tolist()) for ids, lo, hi in sides])])
            return kind, np.unique(kind, return_index=True)[1]
    return kind, first


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * np.uint64(0x9E3779B97F4A7C15) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F) + (x >> np.uint64(29)))


_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Parts of a text between single spaces with no other white space beside them, of ``size`` characters or more."""
    out, at, look = [], 0, size
    while (cut := text.find(" ", look)) >= 0:
        if 0 < cut < len(text) - 1 and not text[cut - 1].isspace() and not text[cut + 1].isspace():
            out.append(text[at:cut])
            at, look = cut + 1, cut + size
        else:
            look = cut + 1
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Columns ``keep`` with n_a, n_b, n_groups, n_links, the groups, and ``pairs``: (pair, n) of the linked id pairs.

    Groups are ``groups`` as text (``a1,a2|b1;a3|b2,b3``) or, with ``digests``, ``groups_sha256`` ('' without tokens).  A pair
    is the number ``a * size of B + b``.
    """
    text_out = "groups_sha256" if digests else "groups"
    new = [*RESULTS, text_out, "pairs"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__text"))
    pair = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in RESULTS]
                          + [T.StructField(text_out, T.StringType()), T.StructField("pairs", T.ArrayType(pair))])

    def run(batches):
        v = vocabularies(a_path, b_path)
        for batch in slices(batches, "__text", 1 << 19):
            texts = batch.column("__text").to_pylist()
            counts, said, pairs = _aligned(v, texts, digests)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(counts[:, k]) for k in range(4)]
                                             + [pa.array(said, pa.string()), pairs], names=schema.names)
    return src.mapInArrow(run, schema)


def _aligned(v: Pair, texts: list[str | None], digests: bool) -> tuple[np.ndarray, list[str], pa.Array]:
    """Counts (n_a, n_b, n_groups, n_links), groups and pairs of a batch of texts."""
    got = [v.tokens(t or "") for t in texts]
    some = [i for i, g in enumerate(got) if g]
    tried = next((i for i in some if len(texts[i]) <= CHECKED), None)
    if tried is not None:
        v.check(texts[tried], got[tried][0])
    counts, said = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    if not some:
        return counts, said, pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1), pa.int32()), _pairs([], []))
    a, b = (np.fromiter(chain.from_iterable(got[i][k] for i in some), np.int64) for k in (0, 1))
    ends = np.cumsum([len(texts[i].encode("utf-8", "surrogatepass")) + 1 for i in some])
    doc, kind, found = v.windows(a, b, ends)
    spelled = np.empty(len(found), object)
    spelled[:] = [f[0] for f in found]
    size = np.array([len(f[1]) // 8 for f in found])
    bounds = np.searchsorted(doc, np.arange(len(some) + 1))
    groups = np.add.reduceat(size[kind], bounds[:-1])
    for k, i in enumerate(some):
        text = ";".join(spelled[kind[bounds[k]:bounds[k + 1]]].tolist())
        said[i] = hashlib.sha256(text.encode()).hexdigest() if digests else text
        counts[i] = len(got[i][0]), len(got[i][1]), groups[k], groups[k]   # a group ends in one link
    # links of all windows: counted by (document, kind of window) first, then by (document, pair)
    dk, times = np.unique(doc * len(found) + kind, return_counts=True)
    d, k = np.divmod(dk, len(found))
    links = np.frombuffer(b"".join([f[1] for f in found]), np.int64)
    start, n = _starts(np.cumsum(size)), size[k]
    codes, code = np.unique(links[_ranges(start[k], start[k] + n)], return_inverse=True)
    dp, back = np.unique(np.repeat(d, n) * len(codes) + code.ravel(), return_inverse=True)
    total = np.bincount(back.ravel(), np.repeat(times, n)).astype(np.int64)
    d, code = np.divmod(dp, len(codes))
    per = np.zeros(len(texts) + 1, np.int64)
    per[np.array(some) + 1] = np.bincount(d, minlength=len(some))
    return counts, said, pa.ListArray.from_arrays(pa.array(np.cumsum(per), pa.int32()), _pairs(codes[code], total))


def _pairs(pair, n) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best) over the corpus; ``best``: no pair of the same B id counts more.

    At most one row a pair of the two vocabularies, and one group of A ids a B id.
    """
    c = materialize(aligned.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("count")), "id-pairs")
    c = c.withColumn("b", F.col("pair") % n_b)
    most = c.groupBy("b").agg(F.max("count").alias("most"))
    return materialize(c.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")


def scores(aligned: DataFrame, counts: DataFrame, row: str, common: int = COMMON_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of the rows with links, ``row`` naming a column that tells rows apart."""
    links = aligned.select(row, F.explode("pairs").alias("p")).select(row, "p.pair", "p.n")
    top = materialize(counts.orderBy(F.desc("count"), "pair").limit(common), "common-pairs")

    def summed(joined):
        return joined.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
                                       F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = summed(links.join(F.broadcast(top), "pair"))
    rare = counts.join(top, "pair", "left_anti")
    if not rare.isEmpty():
        out = out.unionByName(summed(links.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(rare, "pair")))
    return out.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def compare(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False,
            common: int = COMMON_PAIRS) -> DataFrame:
    """:func:`align` with ``n_best`` and ``count_sum`` of each row's links."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_best", "count_sum")]
    al = materialize(align(docs, a_path, b_path, text_col, keep, digests).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(al, vocabularies(a_path, b_path).n_b)
    s = scores(al, counts, "__row", common)
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return al.join(s, "__row", "left").select(*[f"`{c}`" for c in al.columns if c not in ("__row", "pairs")], *zero)


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark, sf_dir: str, paths: tuple[str, str] | None = None) -> DataFrame:
    """Token groups of the two vocabularies and corpus-wide counts of their links for every document."""
    got = compare(documents(spark, sf_dir), *(paths or default_paths()), keep=["doc_id"], digests=True)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
