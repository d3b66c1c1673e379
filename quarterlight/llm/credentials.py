"""Secret scan with multipart linking.  DataFrame functions only.

A credential has several parts: an access identifier, a secret and often an endpoint.  Every secret is linked with the nearest
identifier and the nearest endpoint within its scope, ``SCOPE`` code points before and after its start (ties go to the earlier
one).  It forms a credential if it has an identifier; a strong secret also if it has only an endpoint.  Strong parts are reported
wherever they stand.  Weak parts, such as ``user = ...`` or a long mixed token, are reported only as parts of a credential.
The interval join within scopes takes the last partner before a secret and the first after it from two running windows over the
parts of a document, up and down by place: no pair is written out, the work is linear in the parts but for sorting,
and one shuffle serves the join and the report.

Places are code points, end exclusive.  Spark gives the matches and the pieces between them, so the place of a
match is the running sum of their lengths, taken in blocks of ``BLOCK`` matches.  Defined results: a null or empty text has no
parts; repeated rows are kept apart by a row key made before the shuffle; columns of any name may come along, see ``scan``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlight.llm.common import fresh, whole_text
from quarterlight.operators.joins import computed_once

SCOPE, BLOCK = 400, 256


def _any_case(letters: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", letters)


#: Parts by kind: strong kinds first, in the order in which they are listed in reports.
PATTERNS = {
    "assign": "(" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "weak_id": "(" + _any_case("user|username|login|account_?id|client_?id|key_?id") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""",
    "weak_secret": r"[A-Za-z0-9+/]{20,}",
    "endpoint": r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+;=%-]+",
}
STRONG = ("assign", "access", "hex")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: The length that counts is that of the whole match, or of the value where the pattern has one.
#: A weak secret also needs so many digits, and letters besides.
LEAST_DIGITS = 4
VALUE_GROUP = {"assign": 2, "weak_id": 2}
LEAST = {"assign": 8, "access": 16, "hex": 32, "weak_id": 3, "weak_secret": 20, "endpoint": 10}
#: A text without these cannot hold a part of the kind; a cheap test before the costly one.
NEEDS = {
    "assign": r"[:=]", "access": r"AKIA", "hex": r"[0-9a-f]{32}", "weak_id": r"[:=]", "weak_secret": r"[A-Za-z0-9+/]{20}", "endpoint": r"://",
}


PART = "struct<kind:string,ord:int,start:bigint,stop:bigint>"
PLACE = "struct<start:bigint,ord:int,stop:bigint,kind:string>"


def with_parts(rows: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds ``_<kind>``: the array of the parts of one kind that pass the kind's conditions, in order of place.

    A block's matches are placed from the sum of all blocks before it, so that no step copies an array of all matches.
    """
    column, pattern = F.col(text), F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(column, pattern, F.lit(0))
    values = F.regexp_extract_all(column, pattern, F.lit(VALUE_GROUP.get(kind, 0)))
    gaps = F.slice(F.split(column, PATTERNS[kind], -1), F.lit(1), F.size(hits))
    measured = F.zip_with(
        F.zip_with(hits, values, lambda h, v: F.struct(F.length(h).alias("n"), passes(kind, v).alias("ok"))),
        gaps,
        lambda x, g: F.struct(F.length(g).alias("gap"), x["n"].alias("n"), x["ok"].alias("ok")),
    )
    rows = computed_once(rows, "_measured", F.when(column.rlike(NEEDS[kind]), measured))
    order, zero = list(PATTERNS).index(kind), F.lit(0).cast("long")
    found = F.col("_measured")

    def block(b):
        items = F.slice(found, b * BLOCK + 1, F.lit(BLOCK))
        return F.struct(items.alias("items"), F.aggregate(items, zero, lambda s, x: s + x["gap"] + x["n"]).alias("length"))

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(found) - 1) / BLOCK).cast("int")), block)
    rows = computed_once(rows, "_blocks", F.when(F.size(found) > 0, blocks)).drop("_measured")

    def before(s, x):
        return F.struct((s["at"] + x["length"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def step(s, x):
        start = s["at"] + x["gap"]
        part = F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("ord"), start.alias("start"), (start + x["n"]).alias("stop"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(s["out"], F.array(part))).otherwise(s["out"]).alias("out"))

    none = F.array().cast(f"array<{PART}>")
    starts = F.aggregate("_blocks", F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), before, lambda s: s["out"])
    placed = F.zip_with(
        "_blocks", starts, lambda b, at: F.aggregate(b["items"], F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])
    )
    return computed_once(rows, f"_{kind}", F.coalesce(F.flatten(placed).cast(f"array<{PART}>"), none)).drop("_blocks")


def passes(kind: str, value: Column) -> Column:
    """Whether a match, or its value, is long enough and looks like one of its kind."""
    fits = F.length(value) >= LEAST[kind]
    if kind == "weak_secret":
        digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        fits = fits & (digits >= LEAST_DIGITS) & (digits < F.length(value))
    return fits


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per reported part: ``row`` (a key of the input row), doc_id, text_hash, kind, ord, start, stop, base, credential.

    ``credential`` stands on the row of a secret that forms one: (id, secret, endpoint, distance), where id or endpoint may be null
    and distance is that from the secret's start to the farthest partner's.  An input row without parts gives one row of nulls, so that
    a report can list it; one of nulls may also stand beside others.  Only ``doc_id`` and ``text`` are read.
    """
    rows = docs.select("doc_id", whole_text().alias("_text")).withColumn("row", F.monotonically_increasing_id())
    for kind in PATTERNS:
        rows = with_parts(rows, "_text", kind)
    keys = ["row", "doc_id", "text_hash"]
    # The hash comes first: after the explode it would be taken, and the text carried, once for each part.
    rows = computed_once(rows, "text_hash", F.xxhash64("_text")).select(*keys, F.concat(*[F.col(f"_{k}") for k in PATTERNS]).alias("_parts"))
    parts = rows.select(*keys, F.explode_outer("_parts").alias("p"))
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("p.kind")]
    strong = F.col("p.kind").isin(*STRONG)
    start, stop = F.col("p.start"), F.col("p.stop")
    up, down = (Window.partitionBy("row").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("start"), F.desc("start")))
    # A weak part that overlaps a strong one falls away.
    parts = parts.withColumns({"start": start, "_strong": strong, "_role": role})
    reach, ahead = F.max(F.when(strong, stop)).over(up), F.min(F.when(strong, start)).over(down)
    parts = parts.withColumn("_apart", strong | ~(F.coalesce(reach > start, F.lit(False)) | F.coalesce(ahead < stop, F.lit(False))))
    place = F.struct("p.start", "p.ord", "p.stop", "p.kind")
    of = lambda r: F.when(F.col("_apart") & (F.col("_role") == r), place)
    near = {f"_{r}{i}": f(of(r)).over(w) for r in ("id", "endpoint") for i, f, w in ((0, F.max, up), (1, F.min, down))}
    parts = parts.withColumns(near)

    def nearest(r: str) -> Column:
        """The partner with the smaller distance, the earlier one among equals, if it is within the scope."""
        last, following = F.col(f"_{r}0"), F.col(f"_{r}1")
        behind, ahead = F.col("p.start") - last["start"], following["start"] - F.col("p.start")
        one = F.when(ahead.isNull() | (behind <= ahead), last).otherwise(following)
        return F.when(F.least(behind, ahead) <= scope, one)

    far = lambda x: F.coalesce(F.abs(x["start"] - F.col("p.start")), F.lit(0).cast("long"))
    parts = parts.withColumns({"_id": nearest("id"), "_endpoint": nearest("endpoint")})
    linked = F.col("_apart") & (F.col("_role") == "secret") & (F.col("_id").isNotNull() | (F.col("_strong") & F.col("_endpoint").isNotNull()))
    credential = F.struct(
        F.col("_id").alias("id"), place.alias("secret"), F.col("_endpoint").alias("endpoint"),
        F.greatest(far(F.col("_id")), far(F.col("_endpoint"))).alias("distance"),
    )
    parts = parts.select(*keys, place.alias("own"), "_strong", F.when(linked, credential).alias("credential"))
    # Several secrets may share an identifier or endpoint: each place is reported once.
    partners = F.filter(F.array("credential.id", "credential.endpoint"), lambda x: x.isNotNull())
    shown = F.when(F.col("_strong") | F.col("credential").isNotNull(), F.col("own"))
    parts = parts.select(*keys, "credential", F.explode(F.concat(F.array(shown), F.coalesce(partners, F.array().cast(f"array<{PLACE}>")))).alias("x"), shown.alias("own"))
    own = F.when(F.col("x").eqNullSafe(F.col("own")), F.col("credential"))
    parts = parts.select(*keys, *[F.col(f"x.{c}") for c in ("kind", "ord", "start", "stop")], own.alias("credential"))
    each = parts.groupBy(*keys, "kind", "ord", "start", "stop").agg(F.max("credential").alias("credential"))
    return each.withColumn("base", F.col("kind").isin(*STRONG)).select(*keys, "kind", "ord", "start", "stop", "base", "credential")


def report(parts: DataFrame) -> DataFrame:
    """One row per input row: counts of the strong kinds, digest of their spans, all spans, number of linked weak parts, and the
    credentials by their secrets' places: the parts as identifier+secret+endpoint, then @distance.

    Uses the partitioning of ``scan``; nothing is shuffled again.
    """
    text = F.concat_ws(":", "kind", "start", "stop")
    entry = F.struct("start", "ord", text.alias("t"))

    def joined(which: Column) -> Column:
        spans = F.sort_array(F.collect_list(F.when(which, entry)))
        return F.array_join(F.transform(spans, lambda x: x["t"]), ",")

    found, formed = F.col("kind").isNotNull(), F.col("credential").isNotNull()
    named = lambda p: F.concat_ws(":", p["kind"], p["start"], p["stop"])
    link = F.col("credential")
    shown = [F.when(link[p].isNotNull(), named(link[p])) for p in ("id", "secret", "endpoint")]
    written = F.concat(F.concat_ws("+", *shown), F.lit("@"), link["distance"].cast("string"))
    links = F.sort_array(F.collect_list(F.when(formed, F.struct("start", "ord", written.alias("t")))))
    per = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG],
        joined(F.col("base")).alias("_base"),
        joined(found).alias("spans"),
        F.count_if(found & ~F.col("base")).alias("n_linked"),
        F.count_if(formed).alias("n_credentials"),
        F.array_join(F.transform(links, lambda x: x["t"]), ",").alias("credentials"),
    )
    return per.select("doc_id", *[f"n_{k}" for k in STRONG], F.sha2("_base", 256).alias("base_sha256"), "spans", "n_linked", "n_credentials", "credentials")


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every reported part replaced by ``mark``; other columns stay, a null text too.

    Spans are brought back to the documents by id and text, so that null and repeated ids do no harm; documents
    without parts don't change.
    """
    id_, hash_, spans_ = fresh(docs, "_id", "_hash", "_spans")
    spans = scan(docs).filter(F.col("kind").isNotNull()).groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(spans_))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(whole_text()) == F.col(hash_))
    joined = docs.join(spans, same, "left")
    text = F.col("text")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s, x):
        fresh = F.when(x["start"] >= s["at"], F.concat(s["out"], piece(s["at"], x["start"]), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), fresh.alias("out"))

    end = lambda s: F.concat(s["out"], piece(s["at"], F.length(text).cast("long")))
    clean = F.when(F.col(spans_).isNull(), text).otherwise(F.aggregate(spans_, begin, step, end))
    return joined.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])
