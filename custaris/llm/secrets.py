"""Secrets: base patterns and wide generators, judged by how many owners hold the same value in the whole corpus.

Base spans are the fixed patterns for assignments, access keys and hexadecimal runs; they stay whatever follows.  Wide
generators propose more: private key blocks, web tokens, vendor prefixes, authorization headers, passwords in addresses,
further cue words and random-looking runs.  Every candidate's value is hashed, and the hashes are aggregated over the corpus:
uses, distinct repositories, distinct owners.  A value that ``EXAMPLE_OWNERS`` owners or more hold is a widely copied example;
one of fewer owners is live if its form looks so (no placeholder, no plain words, enough entropy), else dull.  Live candidates
of the generators are added to the base spans; every span carries its verdict.

Texts are read once.  Candidates (hashes, never the values) are written, counted by map-side combined groupings of (hash,
owner, repository), and joined back dealt by (hash, part of the row), so that a value that a third of all rows hold doesn't
meet in one task.

Defined results: null text is empty and has no spans; a null owner is one owner, a null repository one repository of its
owner; equal rows are separate rows of one owner; spans that start together stand in the order of their kinds; of
overlapping candidates the earlier generator's one counts, then the leftmost, and none that overlaps a base span; patterns
are linear in the text's length; an empty table gives no rows; own columns named like a result give way to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPREAD, documents, materialize, slices

BASE = ("assign", "access", "hex")
ADDED = ("key", "jwt", "vendor", "header", "address", "named", "random")
KINDS = BASE + ADDED
EXAMPLE_OWNERS = 5         # owners from which a value is a widely copied example
RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "found")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("passw", "secret", "token", "api")

# generators; a run of characters is tried once, from its start, so that long runs stay linear
_KEY = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+")
# fixed values: public prefixes of vendors' tokens
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-",
            "sk_live_", "rk_live_", "sk-", "AIza", "ASIA", "hf_", "npm_", "pypi-", "shpat_", "dop_v1_", "ya29.", "SG.")
_VENDOR = re.compile(r"(?<![A-Za-z0-9_.-])(?:" + "|".join(map(re.escape, PREFIXES)) + r")[A-Za-z0-9_.-]{12,}+")
_HEADER = re.compile(r"(?<![A-Za-z])(?:[Bb]earer|BEARER|[Bb]asic|BASIC)\x20{1,4}([A-Za-z0-9+/_.~=-]{16,}+)")
_ADDRESS = re.compile(r"://[^\s/:@]{1,256}:([^\s/@]{6,256})@")
CUES = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "contrase")
_NAMED = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|wort)?|mot\x20de\x20passe|contrase(?:ñ|n)a|pwd|secret|token|credentials?|auth"""
                    r"""|(?:api|access|private|secret|auth|client|signing|encryption)[_-]?key)["']?[\x20\t]{0,4}"""
                    r"""(?:=>|->|:=|[:=]|\bis\b)[\x20\t]{0,4}["'`]?([^\s"'`<>,;]{8,256})""", re.I | re.A)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{32}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "change_me", "placeholder", "your", "xxxx", "test", "redacted",
                "insert", "todo", "****", "....", "0000", "1234567", "abcdef", "none", "null", "undefined", "environ", "config")


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def looks_live(kind: str, value: str) -> bool:
    """Whether a value's form is that of a real credential."""
    low = value.lower()
    if kind == "key":
        return len(value) >= 64 and entropy(value) >= 4
    if any(p in low for p in PLACEHOLDERS) or _UUID.fullmatch(value):
        return False
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    other = len(value) - digits - letters
    if not digits or not letters or other > len(value) // 3:
        return False
    mixed = low != value and value.upper() != value
    if kind == "random":  # nothing but its form speaks for it
        return (mixed and digits >= 3 and entropy(value) >= 4 and value.count("/") <= 2 + len(value) // 24
                or bool(re.fullmatch(r"[0-9A-F]{32,}", value)) and entropy(value) >= 3)
    if kind in ("jwt", "vendor", "header"):
        return entropy(value) >= 3
    return entropy(value) >= (3 if len(value) >= 16 else 2.25) and len(set(value)) >= min(8, len(value) - 2)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, leftmost and non-overlapping within a kind, failing matches dropped."""
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out = [("assign", m.start(), m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.group()) for m in _ACCESS.finditer(text)]
    if _LONG_RUN.search(text):
        out += [("hex", m.start(), m.end(), m.group()) for m in _HEX.finditer(text)]
    return order(out)


def order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def proposals(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all generators, in the generators' order; spans may overlap."""
    out = []
    if "PRIVATE KEY" in text:
        begun = None
        for m in _KEY.finditer(text):
            if m.group(1) == "END" and begun:
                out.append(("key", begun.start(), m.end(), "".join(text[begun.end():m.start()].split())))
            begun = m if m.group(1) == "BEGIN" else None
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end(), m.group()) for m in _JWT.finditer(text)]
    if any(p in text for p in PREFIXES):
        out += [("vendor", m.start(), m.end(), m.group()) for m in _VENDOR.finditer(text)]
    low = text.lower()
    if "bearer" in low or "basic" in low:
        out += [("header", m.start(1), m.end(1), m.group(1)) for m in _HEADER.finditer(text)]
    if "://" in text:
        out += [("address", m.start(1), m.end(1), m.group(1)) for m in _ADDRESS.finditer(text)]
    if any(c in low for c in CUES):
        out += [("named", m.start(), m.end(), m.group(1)) for m in _NAMED.finditer(text)]
    if _LONG_RUN.search(text):
        out += [("random", m.start(), m.end(), m.group()) for m in _RANDOM.finditer(text)]
    return out


def candidates(text: str, base) -> list[tuple[str, int, int, str]]:
    """Proposals that overlap no base span and no proposal before them."""
    taken: list[tuple[int, int]] = []  # disjoint, in order of their ends
    reach = 0
    for _, a, e, _ in base:  # base spans of different kinds may overlap: their union is taken
        if taken and a < reach:
            taken[-1] = (reach := max(reach, e), taken[-1][1])
        else:
            taken.append((reach := e, a))
    out = []
    for s in proposals(text):
        i = bisect_left(taken, (s[1] + 1, -1))  # the first that ends after this start
        if i == len(taken) or taken[i][1] >= s[2]:
            insort(taken, (s[2], s[1]))
            out.append(s)
    return out


def spell(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


_FOUND = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("hash", T.StringType()), T.StructField("looks", T.BooleanType())]))


def _read(docs: DataFrame, owner: Column, repository: Column, text_col: str, keep: list[str]) -> DataFrame:
    """Rows with their counts of base spans and all candidates, hashed; one pass over the texts."""
    src = docs.select(*[docs[f"`{c}`"] for c in keep], owner.cast("string").alias("__owner"),
                      repository.cast("string").alias("__repo"), docs[f"`{text_col}`"].alias("__text"))
    out = [f for f in src.schema if f.name != "__text"]
    schema = T.StructType([*out, *[T.StructField(n, T.LongType()) for n in RESULTS[:3]], T.StructField("base_sha256", T.StringType()),
                           T.StructField("found", _FOUND)])
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("looks", pa.bool_())]))

    def run(batches):
        for b in slices(batches, "__text"):
            n, shas, found = ([], [], []), [], []
            for t in b.column("__text").to_pylist():
                t = t or ""
                base = base_spans(t)
                for k, kind in enumerate(BASE):
                    n[k].append(sum(s[0] == kind for s in base))
                shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                found.append([{"kind": k, "start": a, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(),
                               "looks": looks_live(k, v)} for k, a, e, v in order(base + candidates(t, base))])
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in out] + [pa.array(c, pa.int64()) for c in n] + [pa.array(shas, pa.string()), pa.array(found, found_type)],
                names=schema.names)
    return src.mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, uses, repositories, owners) of the values in rows (hash, owner, repo)."""
    own = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses"))
    own = own.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return own.groupBy("hash").agg(F.sum("uses").alias("uses"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, owner: Column, repository: Column, text_col: str = "text", keep: list[str] | None = None,
         example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Columns ``keep`` with counts and digest of the base spans and ``found``: every candidate in order with its verdict.

    ``found`` has kind, start, end (code points, end exclusive), hash, verdict (``live``, ``example`` or ``dull``) and the
    value's uses, repositories and owners in the corpus.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    rows = _read(docs, owner, repository, text_col, keep).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "secrets")
    each = rows.where(F.size("found") > 0).select("__row", F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.explode("found").alias("c"))
    each = materialize(each.select("__row", "owner", "repo", "c.*"), "secret-candidates").withColumn("part", F.pmod("__row", F.lit(SPREAD)))
    known = ownership(each)
    # a hash's counts reach its rows by parts
    parts = each.select("hash", "part").distinct().join(known, "hash")
    verdict = (F.when(F.col("owners") >= example_owners, "example").when(F.col("looks"), "live").otherwise("dull"))
    judged = each.join(parts, ["hash", "part"]).withColumn("verdict", verdict)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    judged = judged.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(  # a row's own candidates
        "start", place.alias("place"), "end", "kind", "hash", "verdict", "uses", "repositories", "owners"))).alias("found"))
    fields = ("kind", "start", "end", "hash", "verdict", "uses", "repositories", "owners")
    judged = judged.select("__row", F.transform("found", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("found"))
    out = [*keep, *RESULTS[:4]]
    with_some = rows.where(F.size("found") > 0).drop("found").join(judged, "__row").select(*[f"`{c}`" for c in out], "found")
    without = rows.where(F.size("found") == 0).select(*[f"`{c}`" for c in out], F.array().cast(judged.schema["found"].dataType).alias("found"))
    return with_some.unionByName(without)


def is_span(c: Column) -> Column:
    """Base spans, and added ones that are live."""
    return c["kind"].isin(*BASE) | (c["verdict"] == "live")


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def mask(docs: DataFrame, owner: Column, repository: Column, text_col: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with every live span of its text replaced by ``<SECRET>``; examples and dull candidates stay."""
    names = docs.columns
    if clash := [c for c in RESULTS if c in names]:
        raise ValueError(f"rename the columns {clash} first")
    scanned = scan(docs, owner, repository, text_col, names, example_owners)
    live = F.transform(F.filter("found", lambda c: c["verdict"] == "live"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    src = scanned.select(*[f"`{c}`" for c in names], live.alias("__live"))

    def run(batches):
        for b in slices(batches, text_col):
            done = []
            for t, spans in zip(b.column(text_col).to_pylist(), b.column("__live").to_pylist()):
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [t[at:s["start"]], "<SECRET>"]
                    at = max(at, s["end"])
                done.append("".join([*out, t[at:]]) if spans else t)
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array(done, b.schema.field(i).type)).select(names)
    return src.mapInArrow(run, docs.schema)


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """Base spans, spans added by corpus-wide ownership, and the verdicts, for every document.

    The table names neither repositories nor owners: a source is an owner, and its documents of one language a repository.
    """
    d = documents(spark, sf_dir)
    s = scan(d, d["source"], F.concat_ws("/", d["source"], F.coalesce(d["lang"], F.lit("-"))), keep=["doc_id"])

    def n(verdict):
        return F.size(F.filter("found", lambda c: c["verdict"] == verdict)).cast("long")
    spans = F.filter("found", is_span)
    return s.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spelled(spans).alias("spans"),
                    n("live").alias("n_live"), n("example").alias("n_example"),
                    F.array_join(F.transform(spans, lambda c: c["verdict"]), ",").alias("verdicts"))
