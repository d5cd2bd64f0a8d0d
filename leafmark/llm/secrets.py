"""Secret scans by assignment-aware lexing.

A small lexer reads source and configuration syntax into (name, literal) pairs: ``name = "v"``,
``name: v``, ``"name": "v"``, ``export NAME=v``, ``<name>v</name>``. Names bound to literals are
constants until they are set again; a use of the name, alone or in a ``+`` chain, takes their value, and so do ``$NAME``
and ``${NAME}``, which also take bare literals. Where a sensitive target takes a constant's value, the
use and the literals at their definitions are reported. A literal's score grows with how sensitive the
target's name is and with how random the literal looks.
Base patterns (assign, access, hex) are always reported beside the lexer's own findings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship_package, table, with_key

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "named", "constant")

#: Words of a target name and how sensitive they are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "private": 0.7, "key": 0.6, "auth": 0.7, "bearer": 0.8, "access": 0.4, "signature": 0.5, "salt": 0.5,
}
#: Cheap tests that a text could hold anything for the lexer: the sensitive words, less those that hold another.
_STEMS = tuple(w for w in SENSITIVE if not any(v != w and v in w for v in SENSITIVE))
_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "api")

_LEX = re.compile(
    # a name starts where its run of characters does, so that long runs are read once
    r"""(?P<q>["']?)(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=q)"""
    r"""(?:[ \t]*:[ \t]*[A-Za-z_][A-Za-z0-9_.\[\]]*+(?=[ \t]*=[^=]))?[ \t]*(?P<op>:=|=>|[:=])(?![=:/])[ \t]*"""
    r"""(?P<rhs>(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|(?:\$\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z0-9+/_.\-=$@!%^&*#~?])+)"""
    r"""(?:[ \t]*\+[ \t]*(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[A-Za-z_][A-Za-z0-9_.]*))*)?"""
    r"""|<(?P<xname>[A-Za-z_][A-Za-z0-9_.\-]*)>(?P<xval>[^<>\n]+)</(?P=xname)>"""
)
_PART = re.compile(r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^\s+"']+""")
_USE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a target's name is, 0 to 1, by its words in snake, kebab or camel case."""
    words = [w.lower() for w in _WORD.findall(name)]
    pairs = {a + b for a, b in zip(words, words[1:], strict=False)}
    return max([SENSITIVE.get(w, 0.0) for w in {*words, *pairs}], default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1: length, entropy, and mixed classes; plain words score low."""
    n = len(value)
    if n < 8 or " " in value:
        return 0.0
    freq = [value.count(c) / n for c in set(value)]
    bits = -sum(p * math.log2(p) for p in freq)
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return max(0.0, min(1.0, (bits - 1.5) / 2.5)) * min(1.0, 0.4 + 0.3 * (classes - 1) + (0.2 if n >= 20 else 0.0))


def lex_pairs(text: str) -> Iterator[tuple[str, str, int, int, bool, tuple[tuple[int, int], ...]]]:
    """(name, literal, start, end, by constant, sources) of every assignment; start and end hold the right side's literal, sources
    the literals of the constants in it."""
    known: dict[str, tuple[str, tuple]] = {}  # quoted constants, by their bare name
    latest: dict[str, tuple[str, tuple]] = {}  # quoted and bare ones, by $NAME
    for m in _LEX.finditer(text):
        if m["xname"]:
            yield m["xname"], m["xval"].strip(), m.start("xval"), m.end("xval"), False, ()
            continue
        if m["rhs"] is None:  # set to an expression that is not read
            known.pop(m["name"], None)
            latest.pop(m["name"], None)
            continue
        name, at, value, through, sources, own = m["name"], m.start("rhs"), [], False, [], []
        quoted = bare = used = 0

        def put(u):
            got = latest.get(u[1] or u[2])
            if got is None:
                return u[0]
            sources.extend(got[1])
            return got[0]

        for p in _PART.finditer(m["rhs"]):
            x = p.group()
            if x[0] in "\"'":
                before = len(sources)
                value.append(_USE.sub(put, x[1:-1]) if x[0] == '"' and "$" in x else x[1:-1])
                through = through or len(sources) > before
                quoted += 1
                own.append((at + p.start() + 1, at + p.end() - 1))
            elif x in known:
                value.append(known[x][0])
                sources.extend(known[x][1])
                through = True
            else:
                before = len(sources)
                value.append(_USE.sub(put, x) if "$" in x else x)
                if len(sources) > before:
                    through = True
                    used += 1
                else:
                    bare += 1
                own.append((at + p.start(), at + p.end()))
        literal = "".join(value)
        known.pop(name, None)
        latest.pop(name, None)
        if quoted or through or bare == 1:
            # a long chain of constants repeats its literals
            held = (literal, tuple(dict.fromkeys([*sources, *own] if not through or quoted or bare else sources)))
            called = text[m.end("rhs"):m.end("rhs") + 1] in ("(", "[")
            if not bare and not used and not called:
                known[name] = held
            if (not bare or (bare == 1 and not quoted)) and not called:
                latest[name] = held
            start, end = at, m.end("rhs")
            if quoted == 1 and not through and not bare:
                start, end = at + 1, end - 1
            yield name, literal, start, end, through, tuple(dict.fromkeys(sources))


def scan_text(text: str | None, threshold: float = 0.35) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, base kinds first at equal starts."""
    text = text or ""
    found: list[tuple[int, int, str]] = []
    told: set[tuple[int, int]] = set()
    low = text.lower()
    if any(s in low for s in _ASSIGN_STEMS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    plain = low.replace("_", "").replace("-", "").replace(".", "")  # two words of a name can make a sensitive one
    if any(s in plain for s in _STEMS) and ("=" in text or ":" in text or "</" in text):
        for name, literal, start, end, through, sources in lex_pairs(text):
            s = name_score(name)
            if s and s * literal_score(literal) >= threshold:
                found.append((start, end, "constant" if through else "named"))
                new = [x for x in sources if x not in told and x[0] < x[1]]
                told.update(new)
                found += [(*x, "constant") for x in new]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no spans
    (spans is the empty string). Repeated rows are scanned each on its own.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                spans = scan_text(text)
                base = [s for s in spans if s[2] in BASE_KINDS]
                n = {k: sum(s[2] == k for s in base) for k in BASE_KINDS}
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_assign": cols[0], "n_access": cols[1], "n_hex": cols[2], "base_sha256": cols[3], "spans": cols[4]})

    return with_key(docs.select("doc_id", "text"), "doc_id", run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret span of text replaced by mark; columns and their order stay, null texts stay null.

    Spans that touch or overlap are replaced together. n_chars, where there, follows the new text.
    """
    ship_package(docs.sparkSession)

    def clean(text):
        if text is None:
            return None
        out, at, merged = [], 0, []
        for a, b, _ in scan_text(text):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [text[at:a], mark]
            at = b
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            new = [clean(t) for t in batch.column(names.index("text")).to_pylist()]
            cols = dict(zip(names, batch.columns, strict=True))
            cols["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in cols:
                old = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([n if t is None else len(t) for n, t in zip(old, new, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
