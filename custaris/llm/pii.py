"""Personal data: base patterns, plus candidate spans scored by boosted trees.

Base spans are the fixed patterns for e-mail, IP, card and phone.  High-recall generators propose further, overlapping
candidates of each kind: addresses with the at sign or dots spelled out or spaced, dotted and hyphenated quads,
digit runs with mixed separators, phone numbers without a plus.  Boosted trees score candidates by format and context
features; the scores are calibrated on held-out candidates, and a candidate becomes a span where the calibrated
probability reaches the kind's threshold and no base span or better candidate overlaps it.

Labels come from the corpus itself: a candidate that a base pattern accepts is positive, one that it rejects negative;
positives are also shown in disguise (plus sign dropped, at sign and dots spelled out), which is what the generators
look for beyond the base.  The fit uses the ``FIT_ROWS`` candidates of smallest hash (a documented bound).

Defined results: null text is empty and has no spans; equal rows are separate documents; an empty table gives no rows;
without positive or negative candidates nothing is added to the base; other columns pass through :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted, isotonic
from .common import documents, materialize, slices, thinned

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 20_000          # candidates that the trees see at most
LEAST_PROBABILITY = 0.95   # calibrated probability from which a candidate is a span
CONTEXT = 24               # characters looked at on either side

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")   # a run of digits is tried once, so long runs stay linear
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# generators: wide nets, one a kind
_G_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}){1,8}")
_G_IP = re.compile(r"[0-9]{1,4}(?: ?[.,:-] ?[0-9]{1,4}){3}")
_G_CARD = re.compile(r"[0-9](?:[ ./-]{0,2}[0-9]){11,22}")
_G_PHONE = re.compile(r"(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,15}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping within a kind, failing matches dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append(("email", a, end))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = "".join(_DIGITS.findall(m.group()))
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


def order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidates of all generators; they may overlap each other and base spans."""
    out = []
    if "@" in text or " at " in text or "at)" in text or "at]" in text or "at}" in text:
        # a span needs an at mark: look only around such marks, so that long texts stay linear
        seen = 0
        for hit in re.finditer(r"@|[(\[{]at[)\]}]| at ", text):
            a = hit.start()
            if a and text[a - 1] == " ":
                a -= 1
            low = max(seen, a - 64)
            while a > low and text[a - 1] in _LOCAL:
                a -= 1
            m = _G_MAIL.match(text, a)
            if m and m.end() > hit.end():
                out.append(("email", m.start(), m.end()))
                seen = m.end()
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _G_IP.finditer(text)]
        out += [("card", m.start(), m.end()) for m in _G_CARD.finditer(text)]
        out += [("phone", m.start(), m.end()) for m in _G_PHONE.finditer(text)]
    return out


CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay"),
        "phone": ("phone", "tel", "call", "fax", "mobil")}
N_FEATURES = 22


def describe(text: str, kind: str, a: int, b: int, surface: str | None = None) -> list[float]:
    """Format features of the span (or of a disguise of it) and context features of its surroundings."""
    s = text[a:b] if surface is None else surface
    digits = "".join(_DIGITS.findall(s))
    groups = re.findall(r"[0-9]+", s)
    low = s.lower()
    before, after = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
    cues = before.lower()
    mail = re.split(r" ?(?:@|[(\[{]at[)\]}]| at ) ?", low, maxsplit=1)
    domain = re.split(r" ?(?:\.|[(\[{]dot[)\]}]| dot ) ?", mail[1]) if len(mail) > 1 else []
    numbers = [int(g) if len(g) <= 6 else 10 ** 6 for g in groups]
    return [float(v) for v in (
        len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        luhn(digits) if digits else 0, max(numbers, default=-1) <= 255 and len(groups) == 4,
        sum(c in " ()./,:-" for c in s), len({c for c in s if c in " ./,:-"}), s.count("("), s.count("."), s.count("-"),
        "@" in s, any(q in low for q in ("(at)", "[at]", "{at}")), "dot" in low, len(domain),
        domain[-1].isalpha() * len(domain[-1]) if domain else 0, any(c.isdigit() for c in mail[0]) if domain else 0,
        any(q in cues for q in CUES[kind]), before[-1:].isalnum(), after[:1].isalnum(), bool(re.search(r"[$€£%#]\s?$", before)))]


def disguises(kind: str, s: str) -> list[str]:
    """Other ways to write a true span: shown to the trees as positives."""
    if kind == "phone":
        return [s.lstrip("+"), "00" + s[1:]]
    if kind == "email":
        name, _, host = s.partition("@")
        return [f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} at {host.replace('.', ' dot ')}"]
    if kind == "card":
        d = "".join(_DIGITS.findall(s))
        return ["/".join(d[k:k + 4] for k in range(0, len(d), 4)), ".".join(d[k:k + 4] for k in range(0, len(d), 4))]
    return [s.replace(".", " . ")]


def _accepted(kind: str, a: int, b: int, base) -> int:
    """1: a base span of the kind is this candidate or holds it; 0: none touches it; -1: overlaps partly or another kind."""
    for k, x, y in base:
        if x < b and a < y:
            return 1 if k == kind and x <= a + 1 and b <= y + 1 else -1
    return 0


def candidate_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, label, x) of every candidate in every text, with the disguises of true ones."""
    schema = "kind string, label int, x array<double>"

    def run(batches):
        for b in slices(batches):
            kinds, labels, xs = [], [], []
            for t in b.column("text").to_pylist():
                t = t or ""
                base = base_spans(t)
                for k, a, e in proposals(t):
                    y = _accepted(k, a, e, base)
                    if y < 0:
                        continue
                    shown = [describe(t, k, a, e)] + ([describe(t, k, a, e, s) for s in disguises(k, t[a:e])] if y else [])
                    kinds += [k] * len(shown)
                    labels += [y] * len(shown)
                    xs += shown
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(labels, pa.int32()),
                                              pa.array(xs, pa.list_(pa.float64()))], names=["kind", "label", "x"])
    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema)


def fit(docs: DataFrame, text_col: str = "text", rows: int = FIT_ROWS) -> dict:
    """kind -> (trees, calibration steps, probabilities); kinds without both labels are left out.

    Equal candidates count once, with their number as weight, so common forms don't fill the bounded sample.
    """
    c = candidate_rows(docs, text_col).groupBy("kind", "label", "x").agg(F.count("*").alias("n"))
    c = materialize(c, "candidates")
    h = F.xxhash64("kind", "label", "x")
    got = thinned(c, h, c.count(), rows).orderBy(h, "kind", "label", "x").limit(rows).collect()
    models = {}
    for kind in KINDS:
        own = [r for r in got if r.kind == kind]
        y = np.array([r.label for r in own], float)
        if len(own) < 40 or y.min(initial=1) == y.max(initial=0):
            continue
        x, w = np.array([r.x for r in own]), np.log1p([r.n for r in own])
        held = np.arange(len(own)) % 3 == 0
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            continue
        trees = Boosted().fit(x[~held], y[~held], w[~held])
        models[kind] = (trees, *isotonic(trees.margin(x[held]), y[held]))
    return models


def added_spans(texts: list[str], bases: list[list], models: dict) -> list[list[tuple[str, int, int]]]:
    """Spans that the method adds to the base ones, for a list of texts."""
    cand = {k: [] for k in models}
    for i, t in enumerate(texts):
        for k, a, e in proposals(t):
            if k in models and not any(x < e and a < y for _, x, y in bases[i]):
                cand[k].append((i, a, e, describe(t, k, a, e)))
    found: list[list] = [[] for _ in texts]
    for k, rows in cand.items():
        if rows:
            trees, left, prob = models[k]
            m = trees.margin(np.array([r[3] for r in rows]))
            p = prob[np.maximum(np.searchsorted(left, m, side="right") - 1, 0)]
            for (i, a, e, _), q in zip(rows, p):
                if q >= LEAST_PROBABILITY:
                    found[i].append((-q, a, KINDS.index(k), e))
    out = []
    for rows in found:
        taken: list[tuple[str, int, int]] = []
        for _, a, k, e in sorted(rows):
            if not any(x < e and a < y for _, x, y in taken):
                taken.append((KINDS[k], a, e))
        out.append(taken)
    return out


def spell(spans) -> str:
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def scan(docs: DataFrame, models: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with counts of base spans, their digest and all spans."""
    keep = [c for c in (docs.columns if keep is None else keep)]
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias("__pi_text"))
    new = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    schema = T.StructType([src.schema[c] for c in keep] + new)

    def run(batches):
        for b in slices(batches, "__pi_text"):
            texts = [t or "" for t in b.column("__pi_text").to_pylist()]
            bases = [order(base_spans(t)) for t in texts]
            more = added_spans(texts, bases, models)
            cols = [pa.array([sum(s[0] == k for s in x) for x in bases], pa.int64()) for k in KINDS]
            cols += [pa.array([hashlib.sha256(spell(x).encode()).hexdigest() for x in bases], pa.string()),
                     pa.array([spell(order(x + y)) for x, y in zip(bases, more)], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, names=[f.name for f in schema])
    return src.mapInArrow(run, schema)


def redact(docs: DataFrame, models: dict | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>``; overlapping spans are joined under the first's kind."""
    models = fit(docs, text_col) if models is None else models
    schema = docs.schema

    def run(batches):
        for b in slices(batches, text_col):
            texts = b.column(text_col).to_pylist()
            bases = [order(base_spans(t or "")) for t in texts]
            more = added_spans([t or "" for t in texts], bases, models)
            done = []
            for t, x, y in zip(texts, bases, more):
                if t is None or not (x or y):
                    done.append(t)
                    continue
                out, at = [], 0
                for k, a, e in order(x + y):
                    if a >= at:
                        out += [t[at:a], f"<{k.upper()}>"]
                    at = max(at, e)
                done.append("".join(out) + t[at:])
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array(done, b.schema.field(i).type))
    return docs.mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Base spans and the method's spans of every document."""
    d = documents(spark, sf_dir)
    return scan(d, fit(d), keep=["doc_id"])
