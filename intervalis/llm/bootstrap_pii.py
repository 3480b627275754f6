"""Personal data by bootstrapped contextual extraction.

Seeds are what four fixed rules find: e-mail and IP addresses, card and phone
numbers. Around each seed, and around every other word that looks like an
identifier, stand lexical patterns: the two words before it, the word before
and the word after, and the two words after. Patterns and instances (a kind of
filler by its normalised text) form a graph, which Spark scores in rounds: a
pattern's confidence for a kind is the share of its fillers' weight that is
known to be of the kind, discounted by its support; an unknown instance's
score for a kind is the noisy-or of its patterns' confidences. After the last
round, instances above the threshold are added as spans wherever one of their
confident patterns surrounds them; the rules' spans stay.

One pass over the texts leaves a thin table of spans and candidates; all
rounds are joins and aggregations of pattern and instance keys, so frequent
patterns are combined before they are shuffled. Null texts are empty; a null id
is kept; repeated rows are answered each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.llm._batches import bound_batches, free_names, tidy
from intervalis.plans.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.9
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMERIC = re.compile(r"[0-9][0-9.\x20-]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BEFORE = re.compile(r"[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D]*\Z)")
#: Words that may be identifiers: a digit or an at sign, and no scheme of a web address.
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = ".,;:!?()[]{}<>\"'"
_REACH = 80


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of the four rules, by kind; matches that fail their check are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    for run in _NUMERIC.finditer(text):  # both rules' matches lie in such runs
        lo, hi = run.span()
        if hi - lo < 7:
            continue
        out["ip"] += [m.span() for m in _IP.finditer(text, lo, hi) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text, lo, hi):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, by kind as listed, then start."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def _clean(word: str) -> str:
    return word.strip(_EDGE).lower()


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical contexts of a span."""
    before = [_clean(w) for w in _WORD.findall(text, max(0, start - _REACH), start)[-2:]]
    after = [_clean(w) for w in _WORD.findall(text, end, end + _REACH)[:3]]
    after = [w for w in after if w][:2]
    out = []
    if len(before) == 2 and all(before):
        out.append(f"{before[0]} {before[1]} _")
    if before and before[-1] and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    return out


_SPAN = "struct<kind:string,start:long,stop:long,instance:string,patterns:array<string>>"


def _found(id_type: pa.DataType):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    schema = pa.schema([("id", id_type), ("text_key", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.string()), ("found", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                by_kind = base_spans(text)
                spans = [(k, s, e) for k in KINDS for s, e in by_kind[k]]
                base = joined(spans)
                found = [{"kind": k, "start": s, "stop": e, "instance": text[s:e].lower(), "patterns": patterns(text, s, e)} for k, s, e in spans]
                taken = sorted((s, e) for _, s, e in spans)
                at = 0
                for m in _CANDIDATE.finditer(text):
                    s, e = m.span()
                    while s < e and text[s] in _EDGE:
                        s += 1
                    while s < e and text[e - 1] in _EDGE:
                        e -= 1
                    while at < len(taken) and taken[at][1] <= s:
                        at += 1
                    if e - s >= 4 and not any(a < e for a, _ in taken[at : at + 1]):
                        found.append({"kind": None, "start": s, "stop": e, "instance": text[s:e].lower(), "patterns": patterns(text, s, e)})
                key = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() if found else ""
                rows.append((doc, key, *(len(by_kind[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The thin table: per row the rules' counts and spans, and all spans and candidates with their patterns."""
    from pyspark.sql.pandas.types import to_arrow_type

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return materialize(rows.mapInArrow(tidy(_found(to_arrow_type(rows.schema["id"].dataType))), f"id {kind}, text_key string, {counts}, base_sha256 string, base string, found array<{_SPAN}>"), "pii-scan")


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (pattern, kind, confidence) and discovered instances (instance, kind, score).

    ``occurrences``: instance, kind (null if unknown), pattern.
    """
    edges = materialize(occurrences.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("weight")), "pii-edges")
    seeds = occurrences.filter("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    known = materialize(seeds, "pii-known")
    seeds, sizes = known, edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("fillers"))
    sure = None
    for _ in range(rounds):
        belief = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support"))
        sure = (
            belief.filter(F.col("support") >= min_support).join(sizes, "pattern")
            .select("pattern", "kind", (F.col("mass") / F.col("fillers") * (1 - F.lit(0.5) ** F.col("support"))).alias("confidence"))
            .filter(F.col("confidence") >= min_confidence)
        )
        sure = materialize(sure, "pii-patterns")
        missed = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9))))
        raised = (
            edges.join(sure, "pattern").join(seeds.select("instance"), "instance", "left_anti")
            .groupBy("instance", "kind").agg((1 - F.exp(missed)).alias("score")).filter(F.col("score") >= min_score)
        )
        known = materialize(seeds.unionByName(raised), "pii-known")
    return sure, known.join(seeds.select("instance"), "instance", "left_anti")


def added_spans(thin: DataFrame, **thresholds) -> DataFrame:
    """Spans the bootstrapping adds: id, text_key, kind, start, stop; once for each id and text."""
    spans = thin.select("id", "text_key", F.explode("found").alias("s")).select("id", "text_key", "s.*")
    occurrences = spans.select("kind", "instance", F.explode("patterns").alias("pattern"))
    sure, new = bootstrap(occurrences, **thresholds)
    open_ = spans.filter("kind is null").select("id", "text_key", "start", "stop", "instance", F.explode("patterns").alias("pattern"))
    hits = open_.join(sure, "pattern").join(new.select("instance", "kind"), ["instance", "kind"])
    best = hits.groupBy("id", "text_key", "start", "stop").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    return best.select("id", "text_key", F.col("b.kind").alias("kind"), "start", "stop")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone and base_sha256 of the rules' spans, spans (all), n_added."""
    thin = scan(docs, id_col, text_col)
    extra = added_spans(thin, **thresholds).groupBy("id", "text_key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra"))
    rows = thin.drop("found").join(extra.withColumnsRenamed({"id": "x_id", "text_key": "x_key"}), F.col("id").eqNullSafe(F.col("x_id")) & (F.col("text_key") == F.col("x_key")), "left")
    base = F.filter(F.transform(F.split("base", ","), lambda t: F.split(t, ":")), lambda t: F.size(t) == 3)
    rank = F.create_map(*(F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)))
    every = F.concat(
        F.transform(base, lambda t: F.struct(rank[t[0]].alias("k"), t[1].cast("long").alias("start"), t[2].cast("long").alias("stop"), t[0].alias("kind"))),
        F.coalesce(F.transform("extra", lambda t: F.struct(rank[t["kind"]].alias("k"), t["start"].alias("start"), t["stop"].alias("stop"), t["kind"].alias("kind"))), F.array().cast("array<struct<k:int,start:bigint,stop:bigint,kind:string>>")),
    )
    text = F.array_join(F.transform(F.array_sort(every), lambda t: F.concat_ws(":", t["kind"], t["start"], t["stop"])), ",")
    return rows.select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), "base_sha256", text.alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_added"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with all found spans masked in the text; null texts stay null."""
    mine, found_id, found_key, more = free_names(docs, "pii_text_key", "pii_id", "pii_key", "pii_extra")
    found = added_spans(scan(docs, id_col, text_col), **thresholds)
    extra = found.groupBy("id", "text_key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias(more)).withColumnsRenamed({"id": found_id, "text_key": found_key})
    rows = docs.withColumn(mine, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.join(extra, F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(mine) == F.col(found_key)), "left").select(*docs.columns, more)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, added in zip(batch.column(place).to_pylist(), batch.column(more).to_pylist(), strict=True):
                if text is not None:
                    spans = [(k, s, e) for k, v in base_spans(text).items() for s, e in v] + [(x["kind"], x["start"], x["stop"]) for x in added or []]
                    text = masked(text, spans) if spans else text
                texts.append(text)
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return rows.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
