"""Personal data: rule-based spans, and more of them by bootstrapped contextual extraction.

The spans of the rules are seeds, and so are long random-looking strings, which may be secrets. Words that stand before and
after them, and around other strings of an identifier's shape, form a graph of patterns and instances. Rounds of joins score
it: a pattern by the share of its mentions that are known to be of a kind, an instance by the patterns it is met with.
Instances that score ACCEPT or more and could be of that kind become spans as well. A secret is a span only if a pattern
vouches for it: such a string in any other place may be a checksum.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseframe.llm.common import drop_stored, stored

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans: the rules', and what only the method finds.
ALL_KINDS = (*KINDS, "secret")
ROUNDS, SUPPORT, SMOOTH, TRUST, ACCEPT = 3, 3, 1.0, 0.5, 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Strings of an identifier's shape: digits with separators, e-mail addresses written out, and letters mixed with digits.
_NUMBER = re.compile(r"[(+]?[0-9](?:[() ./-]{0,3}+[0-9])++")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT|@)[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({]?(?:dot|DOT|\.)[\])}]? ?[A-Za-z0-9-]{1,63})+")
_MIXED = re.compile(r"[A-Za-z0-9_+/-]{16,}=*")
#: Length from which such a string is a seed, and the letters and digits that any has at least.
SEED_LENGTH, MIX = 32, 4
#: Characters beside a string in which the words of its context are looked for.
NEAR = 120
_QUOTES = "\"'`([{<>}])"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Work outwards from each @: no character is looked at more than a few times, whatever the text."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            pos = found.end()
            out.append((start, pos))
        at = text.find("@", max(pos, at + 1))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind and start."""
    mail, digit = "@" in text, bool(_DIGIT.search(text))
    out = [("email", *s) for s in _emails(text)] if mail else []
    if digit:
        out += [("ip", *s) for s in _ips(text)] + [("card", *s) for s in _cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in _phones(text)]
    return out


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _context(text: str, start: int, end: int) -> list[str]:
    """Patterns of what stands beside a string: two words before it, the last alone if it announces something, two after it."""
    out = []
    before = re.sub("[0-9]+", "0", text[max(0, start - NEAR) : start].rstrip(_QUOTES).lower()).split()
    if len(before) > 1:
        out.append(f"{before[-2]} {before[-1]} _")
    if before and before[-1][-1] in ":=#":
        out.append(f"{before[-1]} _")
    after = re.sub("[0-9]+", "0", text[end : end + NEAR].lstrip(_QUOTES).lower()).split()
    if len(after) > 1:
        out.append(f"_ {after[0]} {after[1]}")
    return out


def _clear_of(taken: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of spans that overlap none of taken: one sweep over both, sorted."""
    taken, out, i, end = sorted(taken), [], 0, -1
    for a, b in sorted(spans):
        while i < len(taken) and taken[i][0] < b:
            end = max(end, taken[i][1])
            i += 1
        if end <= a:
            out.append((a, b))
    return out


def mentions(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, str | None, int, int, list[str]]]]:
    """The rule's spans; and (instance, kind or None, start, end, patterns) of those and of other likely strings."""
    spans, out = base_spans(text), []
    for kind, a, b in spans:
        out.append((text[a:b].lower(), kind, a, b, _context(text, a, b)))
    taken = [(a, b) for _, a, b in spans]
    mixed = [m.span() for m in _MIXED.finditer(text) if sum(c.isdigit() for c in m[0]) >= MIX and sum(c.isalpha() for c in m[0]) >= MIX]
    secrets = _clear_of(taken, mixed)
    for a, b in secrets:
        out.append((text[a:b], "secret" if b - a >= SEED_LENGTH else None, a, b, _context(text, a, b)))
    likely: list[tuple[int, int]] = []
    low = text.lower()
    if any(x in low for x in ("(at)", "[at]", "{at}", "(@)", "[@]", "{@}")):
        likely += _clear_of(taken + secrets, [m.span() for m in _SPELT.finditer(text)])
    if _DIGIT.search(text):
        lo = 0
        for a, b in sorted([*taken, *secrets, *likely, (len(text), len(text))]):
            if a > lo:  # numbers lie between what is known
                likely += [m.span() for m in _NUMBER.finditer(text, lo, a) if 7 <= sum(c.isdigit() for c in m[0]) <= 19]
            lo = max(lo, b)
    for a, b in likely:
        out.append((text[a:b].lower(), None, a, b, _context(text, a, b)))
    return spans, out


def could_be(text: str) -> list[str]:
    """The kinds whose shape an instance has."""
    digits = sum(c.isdigit() for c in text)
    if _MIXED.fullmatch(text) and digits >= MIX and any(c.isalpha() for c in text):
        return ["secret"]
    if any(c.isalpha() for c in text):
        return ["email"]
    kinds = []
    if len(re.findall("[0-9]+", text)) == 4 and digits <= 12:
        kinds.append("ip")
    if 13 <= digits <= 19:
        kinds.append("card")
    if 7 <= digits <= 15:
        kinds.append("phone")
    return kinds


_FOUND = "doc_id long, key long, base string, seen array<struct<inst:string,kind:string,a:int,b:int,pats:array<string>,may:array<string>>>"
_SEEN = pa.list_(pa.struct([("inst", pa.string()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("pats", pa.list_(pa.string())), ("may", pa.list_(pa.string()))]))


def text_key(text: str) -> int:
    """Tells rows of one doc_id with different texts apart."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, base, seen = [], [], []
        for text in b.column(1):
            text = text.as_py() or ""
            spans, met = mentions(text)
            keys.append(text_key(text))
            base.append(spans_text(spans))
            seen.append([{"inst": i, "kind": k, "a": x, "b": y, "pats": p, "may": [k] if k else could_be(i)} for i, k, x, y, p in met])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(base, pa.string()), pa.array(seen, _SEEN)], ["doc_id", "key", "base", "seen"])


def bootstrap(found: DataFrame) -> DataFrame:
    """Instances that the patterns vouch for, (inst, kind, trust), from the mentions in found; stored."""
    seen = found.select("doc_id", F.explode("seen").alias("m")).select("doc_id", "m.*")
    links = stored(seen.select("inst", F.explode("pats").alias("pat")).groupBy("pat", "inst").agg(F.count("*").alias("n")), "pii-links")
    seeds = seen.where("kind is not null").select("inst", "kind").distinct()
    may = seen.where("kind is null or kind = 'secret'").select("inst", F.explode("may").alias("kind")).distinct()
    totals = links.groupBy("pat").agg(F.sum("n").alias("total"))
    one = F.lit(1.0).alias("trust")
    news = None
    for _ in range(ROUNDS):
        known = seeds.select("inst", "kind", one)
        if news is not None:
            known = known.union(news.join(seeds, ["inst", "kind"], "left_anti"))
        backed = links.join(known, "inst").groupBy("pat", "kind").agg(F.sum(F.col("n") * F.col("trust")).alias("pos"), F.count("*").alias("insts"))
        pats = backed.join(totals, "pat").withColumn("score", F.col("pos") / (F.col("total") + SMOOTH))
        pats = pats.where((F.col("insts") >= SUPPORT) & (F.col("score") >= TRUST)).select("pat", "kind", "score")
        # not all patterns of an instance are independent, so one that is sure is never fully trusted
        doubt = F.log(1 - F.least(F.col("score"), F.lit(0.95)))
        fresh = links.join(pats, "pat").join(may, ["inst", "kind"]).groupBy("inst", "kind").agg((1 - F.exp(F.sum(doubt))).alias("trust"))
        fresh = stored(fresh.where(F.col("trust") >= TRUST), "pii-known")
        if news is not None:
            drop_stored(news)
        news = fresh
    drop_stored(links)
    return news.where(F.col("trust") >= ACCEPT)


def _added(found: DataFrame) -> DataFrame:
    """Spans beyond the rules': (doc_id, key, more)."""
    good = bootstrap(found)
    seen = found.select("doc_id", "key", F.explode("seen").alias("m")).select("doc_id", "key", "m.inst", "m.kind", "m.a", "m.b").where("kind is null or kind = 'secret'").drop("kind")
    best = good.groupBy("inst").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    span = F.concat_ws(":", "kind", "a", "b")
    return seen.join(best, "inst").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(span)).alias("more"))


def _ordered(base, more):
    """All spans of a row in order, as a string."""
    every = F.concat(F.filter(F.split(base, ","), lambda s: s != ""), F.coalesce(more, F.array().cast("array<string>")))
    place = F.array(*[F.lit(k) for k in ALL_KINDS])
    keyed = F.transform(
        every,
        lambda s: F.struct(
            F.array_position(place, F.element_at(F.split(s, ":"), 1)).alias("k"),
            F.element_at(F.split(s, ":"), 2).cast("int").alias("a"),
            F.element_at(F.split(s, ":"), 3).cast("int").alias("b"),
            s.alias("s"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["s"]), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (the rules'), base_sha256, spans, n_spans.

    A null text counts as empty; empty texts have no spans. Rows that repeat a doc_id are rows of their own, also with a
    null doc_id; equal rows get equal results. Offsets are code points, end exclusive. Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = stored(src.mapInArrow(_find, _FOUND), "pii-found")
    more = _added(found).withColumnsRenamed({"doc_id": "d", "key": "k"})
    joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    count = lambda kind: F.coalesce(F.regexp_count("base", F.lit(f"{kind}:")), F.lit(0)).cast("long").alias(f"n_{kind}")
    return joined.select("doc_id", *[count(k) for k in KINDS], F.sha2("base", 256).alias("base_sha256"), _ordered(F.col("base"), F.col("more")).alias("spans")).withColumn(
        "n_spans", F.coalesce(F.regexp_count("spans", F.lit("[a-z]+:")), F.lit(0)).cast("long")
    )


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Put <KIND> in the place of each span; where spans overlap, one mark of the first covers them together."""
    out, pos, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[pos:a], f"<{kind.upper()}>"]
        end = max(end, b)
        pos = end
    return "".join(out) + text[pos:]


def pii_redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind; n_chars follows the text, null texts stay null."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = stored(src.where(F.col("text").rlike("[0-9@]") | F.col("text").rlike(r"(?i)[\[({]at[\])}]")).mapInArrow(_find, _FOUND), "pii-found")
    more = stored(_added(found).withColumnsRenamed({"doc_id": "_d", "key": "_k"}), "pii-more")
    drop_stored(found)
    columns, schema = docs.columns, docs.schema
    own_key = "_key" + "_" * max(len(c) for c in columns)  # longer than any name of docs
    text_at, id_at = columns.index("text"), columns.index("doc_id")
    chars_at = columns.index("n_chars") if "n_chars" in columns else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [b.column(i) for i in range(len(columns))]
            extra = b.column(len(columns)).to_pylist() if b.num_columns > len(columns) else [None] * b.num_rows
            texts = []
            for t, e in zip(b.column(text_at), extra, strict=True):
                t = t.as_py()
                if t:
                    own = [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in e or [])]
                    spans = base_spans(t) + own
                    t = redact(t, spans) if spans else t
                texts.append(t)
            arrays[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                arrays[chars_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(arrays[chars_at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    if more.isEmpty():
        return docs.mapInArrow(mask, schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([text_key(t.as_py() or "") for t in b.column(text_at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], [*columns, own_key])

    wide = docs.mapInArrow(keyed, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{own_key}` long")
    joined = wide.join(more, (wide[columns[id_at]].eqNullSafe(more["_d"])) & (wide[own_key] == more["_k"]), "left")
    return joined.select(*[wide[c] for c in columns], more["more"].alias(own_key)).mapInArrow(mask, schema)
