"""Personal data and secrets: fixed base patterns and named secrets seed a bootstrapped contextual extraction.

1. One pass over the texts finds the base entities (email, ip, card, phone), the secrets that stand behind a name for
   one (``token = "..."``) or have a public key format, and all other tokens that could be identifiers (a digit or an
   at-sign, four letters or digits, any length). Each occurrence carries its lexical patterns: the two words before it,
   the words on both sides, the word before it with the shape of the token, and the signs before it with that word or
   that shape. Words and shapes keep the signs that stand between the last word and the token.
2. Distinct (pattern, value) pairs are the graph. In each round Spark scores patterns by the share of their values
   known for a kind among those that could be of it, keeps those with enough known values and confidence, and scores values by the
   patterns that hold them (one minus the product of the patterns' doubts). Values above the threshold count as
   known in the next round, so they induce further patterns.
3. Occurrences of values that end above the threshold become spans of their best kind, beside the base spans. A value
   can only be of a kind that its characters allow (``plausible``): a number that fails Luhn is no card, whatever
   stands before it.

Counting distinct values keeps copies of a text from voting twice. A frequent pattern or value is summed before
the shuffle, and joins on it can be split. Words and values above ``NAMED`` characters stand as digests of themselves.

Defined cases: a null text is an empty one and has no spans; repeated rows give repeated results; the kind that
comes first in the list wins ties between kinds; empty tables give empty results; other columns are kept as they
are, and where one has the name of a result column, that result column gets underscores before its name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lodestat.llm.common import fresh, identified, q, stored, text_blocks

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SECRET = ALL_KINDS.index("secret")
NAMED = 64
RESULTS = ("__base", "__base_text", "__spans")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so the look-behind changes nothing but the time taken.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS_OR_AT = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
WORDS = re.compile(r"\w+")
# Names that secrets are assigned to, and public formats of keys.
NAMED_SECRET = re.compile(
    r"(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?\s*[=:]\s*[\"']?([^\s\"'|,;]{8,})", re.I
)
KEY_FORMAT = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}")
# What a discovered value of a kind must look like.
ADDRESS = re.compile(r".+(@|\(at\)|\[at\]).+")
HOST = re.compile(r"[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}|[0-9]{1,3}([._-][0-9]{1,3}){3}", re.I)
NUMBER = re.compile(r"[0-9][0-9._/-]*")
CALL = re.compile(r"[+(]*[0-9][0-9()./-]*((x|ext\.?)[0-9]+)?", re.I)


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern: a match holds one at-sign, so each at-sign is tried once with what stands around it."""
    spans, low, at = [], 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
        low = found.end() if found else at + 1
        at = text.find("@", low)
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, ordered by kind and start."""
    spans = [(0, *s) for s in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


def secrets(text: str) -> list[tuple[int, int, int]]:
    """Named secrets with a letter and a digit, and keys of a public format; a match inside another one is left out."""
    found = [m.span(1) for m in NAMED_SECRET.finditer(text) if mixed_signs(m[1])] + [m.span() for m in KEY_FORMAT.finditer(text)]
    spans, after = [], 0
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= after:
            spans.append((SECRET, start, end))
            after = end
    return spans


def mixed_signs(token: str) -> bool:
    return any(map(str.isdigit, token)) and any(map(str.isalpha, token))


def other_tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that overlap no taken span, without the punctuation around them."""
    spans, after = [], 0
    busy = sorted((s, e) for _, s, e in taken)
    for m in DIGITS_OR_AT.finditer(text):
        at = m.start()
        if at < after:
            continue
        start = at
        while start > after and not text[start - 1].isspace():
            start -= 1
        stop = SPACE.search(text, at)
        end = after = stop.start() if stop else len(text)
        token = text[start:end]
        start += len(token) - len(token.lstrip("\"'([{<*#$%&!?.,;:="))
        end -= len(token) - len(token.rstrip("\"')]}>*#$%&!?.,;:="))
        if end > start and sum(map(str.isalnum, text[start:end])) >= 4:
            spans.append((start, end))
    free, k = [], 0
    for s, e in spans:
        while k < len(busy) and busy[k][1] <= s:
            k += 1
        if k == len(busy) or busy[k][0] >= e:
            free.append((s, e))
    return free


def named(text: str) -> str:
    """The text itself, or a digest of a long one."""
    return text if len(text) <= NAMED else "#" + blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def plausible(token: str) -> int:
    """The kinds that a token's characters allow, as bits."""
    digits = re.sub("[^0-9]", "", token) if len(token) <= 2 * NAMED else ""
    number = NUMBER.fullmatch(token) and 15 <= len(digits) <= 19
    host = HOST.fullmatch(token) and all(len(p) > 3 or int(p) <= 255 for p in re.split("[._-]", token) if p.isdigit())
    allowed = (
        ADDRESS.fullmatch(token),
        host,
        number and luhn(digits),
        7 <= len(digits) <= 15 and CALL.fullmatch(token),
        len(token) >= 8 and "@" not in token and mixed_signs(token),
    )
    return sum(1 << k for k, yes in enumerate(allowed) if yes)


def allowed(token: str, kind: int | None) -> int:
    return plausible(token) if kind is None else 1 << kind


def shape(token: str) -> str:
    """Runs of digits and letters as one sign each; keys of many such runs as their alphabet and length."""
    low = token.lower()
    short = re.sub("[a-z]+", "a", re.sub("[0-9]+", "9", low))
    if len(short) > 6 and re.fullmatch("[9a]+", short):
        return f"{'hex' if re.fullmatch('[0-9a-f]+', low) else 'mix'}{len(low)}"
    return named(short)


class Context:
    """Lexical patterns of occurrences in one text, whose words are found once."""

    def __init__(self, text: str) -> None:
        self.text = text
        spans = [m.span() for m in WORDS.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def word(self, k: int) -> str:
        return named(self.text[self.starts[k] : self.ends[k]].lower())

    def patterns(self, start: int, end: int) -> list[str]:
        before, after = bisect_right(self.ends, start) - 1, bisect_left(self.starts, end)
        gap = self.text[self.ends[before] if before >= 0 else 0 : start]
        signs, kind = named("".join(gap.split())), shape(self.text[start:end])
        out = [f"{signs} {kind}"] if signs else []
        if before >= 0:
            out.append(f"{self.word(before)} {signs} {kind}")
            if signs:
                out.append(f"{self.word(before)} {signs} _")
            if before:
                out.append(f"{self.word(before - 1)} {self.word(before)} {signs} _")
            if after < len(self.starts):
                out.append(f"{self.word(before)} {signs} _ {self.word(after)}")
        return out


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
SEEN = pa.struct([*SPAN, ("value", pa.string()), ("allowed", pa.int32()), ("patterns", pa.list_(pa.string()))])
SPAN_FIELDS = [StructField("kind", IntegerType()), StructField("start", LongType()), StructField("end", LongType())]
SEEN_FIELDS = [*SPAN_FIELDS, StructField("value", StringType()), StructField("allowed", IntegerType()), StructField("patterns", ArrayType(StringType()))]
FOUND = [
    StructField("base", ArrayType(StructType(SPAN_FIELDS))),
    StructField("base_text", StringType()),
    StructField("seen", ArrayType(StructType(SEEN_FIELDS))),
]
SPECIAL = np.zeros(256, bool)
SPECIAL[48:58] = SPECIAL[64] = SPECIAL[43] = True


def _scan(batches):
    for part, data, offsets in text_blocks(batches):
        marks = np.concatenate([[0], np.cumsum(SPECIAL[data])])
        marked = marks[offsets[1:]] > marks[offsets[:-1]]
        base, joined, seen = [], [], []
        for k in range(len(offsets) - 1):
            if not marked[k]:
                base.append([]), joined.append(""), seen.append([])
                continue
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            own = base_spans(text)
            base.append([{"kind": a, "start": s, "end": e} for a, s, e in own])
            joined.append(",".join(f"{ALL_KINDS[a]}:{s}:{e}" for a, s, e in own))
            taken = [*own, *secrets(text)]
            spans = [*taken, *((None, s, e) for s, e in other_tokens(text, taken))]
            context = Context(text) if spans else None
            seen.append(
                [
                    {"kind": a, "start": s, "end": e, "value": named(text[s:e].lower()), "allowed": allowed(text[s:e], a), "patterns": context.patterns(s, e)}
                    for a, s, e in spans
                ]
            )
        names = [n for n in part.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(n) for n in names), pa.array(base, pa.list_(SPAN)), pa.array(joined, pa.string()), pa.array(seen, pa.list_(SEEN))],
            [*names, "base", "base_text", "seen"],
        )


def learn(seen: DataFrame, rounds: int, min_values: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (pattern, kind, confidence) and of values (value, kind, score) after the last round.

    ``seen`` has one row per occurrence: kind (null where unknown), value, allowed (kinds it can be of, as bits), patterns.
    """
    edges = stored(
        seen.select("value", "kind", "allowed", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.min("kind").alias("kind"), F.bit_or("allowed").alias("allowed")),
        "pii-graph",
    )
    seeds = seen.filter("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    totals = edges.groupBy("pattern").agg(F.array(*[F.sum(F.getbit(F.col("allowed"), F.lit(k))) for k in range(len(ALL_KINDS))]).alias("n"))
    known = stored(seeds, "pii-values")
    scored = None
    for _ in range(rounds):
        support = edges.join(known.select("value", F.col("kind").alias("__k"), "score"), "value").groupBy("pattern", "__k").agg(
            F.sum("score").alias("weight"), F.count("*").alias("values")
        )
        scored = stored(
            support.filter(F.col("values") >= min_values)
            .join(totals, "pattern")
            .select("pattern", F.col("__k").alias("kind"), (F.col("weight") / (F.element_at("n", F.col("__k") + 1) + 1)).alias("confidence"))
            .filter(F.col("confidence") >= min_confidence),
            "pii-patterns",
        )
        doubts = (
            edges.filter("kind IS NULL AND allowed > 0")
            .drop("kind")
            .join(scored, "pattern")
            .filter(F.getbit(F.col("allowed"), F.col("kind")) == 1)
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
            .filter(F.col("score") >= min_confidence)
            .groupBy("value")
            .agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
            .select("value", (-F.col("best.k")).alias("kind"), F.col("best.score").alias("score"))
        )
        known = stored(seeds.unionByName(doubts.join(seeds.select("value"), "value", "left_anti")), "pii-values")
    return scored, known


def _found(docs: DataFrame, text_col: str, keep: list[str], rounds: int, min_values: int, min_confidence: float) -> DataFrame:
    """Rows (kept, base, base_text, spans); ``kept`` is a struct of the columns ``keep``, so that no name can clash."""
    none = F.lit(0).alias(fresh(docs, "__none"))
    texts = identified(docs.select(F.struct(none, *[q(c) for c in keep]).alias("kept"), q(text_col).alias("text")), "row")
    schema = StructType([*(f for f in texts.schema.fields if f.name != "text"), *FOUND])
    found = stored(texts.mapInArrow(_scan, schema), "pii-found")
    seen = found.select("row", F.inline("seen"))
    _, known = learn(seen, rounds, min_values, min_confidence)
    known = known.select("value", F.col("kind").alias("learned"))
    met = seen.filter(F.col("kind").isNull() & (F.col("allowed") > 0)).join(known, "value")
    met = met.filter(F.getbit(F.col("allowed"), F.col("learned")) == 1).select("row", F.col("learned").alias("kind"), "start", "end")
    added = met.unionByName(seen.filter(F.col("kind") == SECRET).select("row", "kind", "start", "end"))
    new = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<kind:int,start:long,end:long>>"))))
    return found.join(new, "row", "left").select("kept", "base", "base_text", spans.alias("spans"))


def extract(
    docs: DataFrame, text_col: str = "text", rounds: int = 3, min_values: int = 3, min_confidence: float = 0.5
) -> DataFrame:
    """``docs`` without its text column, with ``__base``, ``__base_text`` and ``__spans`` (base and discovered spans)."""
    keep = [c for c in docs.columns if c != text_col]
    found = _found(docs, text_col, keep, rounds, min_values, min_confidence)
    results = [q(c).alias(fresh(docs, name)) for c, name in zip(("base", "base_text", "spans"), RESULTS)]
    return found.select(*[F.col("kept").getField(c).alias(c) for c in keep], *results)


def _masked(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{ALL_KINDS[s['kind']]}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _mask(batches):
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        texts = (None if t is None else _masked(t, s) for t, s in zip(batch.column("text").to_pylist(), spans))
        yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string())], ["kept", "masked"])


def masked(docs: DataFrame, text_col: str = "text", rounds: int = 3, min_values: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a null text stays null."""
    found = _found(docs, text_col, docs.columns, rounds, min_values, min_confidence)
    texts = found.select("kept", F.col("kept").getField(text_col).alias("text"), "spans")
    kept = texts.schema["kept"]
    out = texts.mapInArrow(_mask, StructType([kept, StructField("masked", StringType())]))
    return out.select(*[F.col("masked").alias(c) if c == text_col else F.col("kept").getField(c).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans as text, and the count of secrets."""
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    text = F.transform("__spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]))
    count = lambda spans, name: F.size(F.filter(spans, lambda s: s["kind"] == ALL_KINDS.index(name))).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id",
        *[count("__base", name) for name in KINDS],
        F.sha2("__base_text", 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
        count("__spans", "secret"),
    )
