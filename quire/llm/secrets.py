"""Secrets in texts: sure finds by pattern, weak ones where complementary parts meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import text_of
from quire.operators.skew import cut_lineage

# Kinds in the order in which spans of one start are listed.
BASE = ("assign", "access", "hex")
LINKED = ("key_id", "key_secret", "endpoint")

# The patterns of the base kinds.
PATTERNS = {
    "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
              r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "key_id": r"(?<![A-Za-z0-9+/])[A-Z0-9]{16,}(?![A-Za-z0-9+/])",
    "key_secret": r"[A-Za-z0-9+/]{40,}",
    "endpoint": r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+""",
}
# A text without a match of these has no find of the kind.
GUARDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "key_id": r"[A-Z0-9]{16}",
    "key_secret": r"[A-Za-z0-9+/]{40}",
    "endpoint": r"://",
}
SCOPE = 400


def _long_enough(kind: str) -> Column:
    """Which matches count; the others only take up their place."""
    found, value = F.col("hit"), F.col("value")
    letter, digit = found.rlike("[A-Za-z]"), found.rlike("[0-9]")
    return {
        "assign": F.length(value) >= 12,
        "access": F.length(found) >= 18,
        "hex": F.length(found) >= 16,
        "key_id": letter & digit & ~found.startswith("AKIA"),
        "key_secret": found.rlike("[a-z]") & found.rlike("[A-Z]") & digit,
        "endpoint": F.lit(True),
    }[kind]


def _matches(kind: str) -> Column:
    """The matches of a kind in a text with the lengths of the gaps before them."""
    text, pattern = F.col("text"), PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if kind == "assign" else 0))
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    named = F.transform(rows, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["hit"].alias("hit"),
        x["value"].alias("value")))
    return F.when(text.rlike(GUARDS[kind]), named).otherwise(F.array().cast(_MATCHES))


_MATCHES = "array<struct<kind:string,gap:int,hit:string,value:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, content, found`` per row: all matches of all kinds, written."""
    narrow = docs.select("doc_id", text_of().alias("text"))
    columns = {kind: _matches(kind) for kind in PATTERNS}
    found = narrow.select(
        "doc_id", F.xxhash64("text").alias("content"), F.array(*columns.values()).alias("found"))
    return cut_lineage(found, "secret-scan")


def parts(scanned: DataFrame) -> DataFrame:
    """``doc_id, content, kind, start, end, mixed`` for every match that is long enough.

    The place of a match is the sum of the gaps and matches before it, in code points.
    """
    rows = scanned.select("doc_id", "content", F.explode("found").alias("matches")).where(
        F.size("matches") > 0)
    each = rows.select("doc_id", "content", F.posexplode("matches").alias("i", "m")).select(
        "doc_id", "content", "i", "m.*").where("hit is not null")
    each = each.dropDuplicates(["doc_id", "content", "kind", "i"])  # repeated rows
    along = Window.partitionBy("doc_id", "content", "kind").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    length = F.length("hit")
    end = F.sum(F.col("gap") + length).over(along)
    found = each.select(
        "doc_id", "content", "kind", "hit", "value", (end - length).alias("start"),
        end.alias("end"))
    fits = F.coalesce(*[F.when(F.col("kind") == k, _long_enough(k)) for k in PATTERNS])
    return found.where(fits).select(
        "doc_id", "content", "kind", "start", "end",
        (F.col("hit").rlike("[a-f]") | (F.length("hit") >= 32)).alias("mixed"))


def _role() -> Column:
    kind = F.col("kind")
    return (
        F.when(kind.isin("access", "key_id"), "id")
        .when(kind.isin("assign", "key_secret"), "secret")
        .when((kind == "hex") & F.col("mixed"), "secret")
        .when(kind == "endpoint", "endpoint"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The sure finds, and the weak ones that have a complementary part within ``scope``.

    An access identifier needs a secret, a weak secret an identifier or an endpoint, an
    endpoint an identifier or a secret. A weak find that overlaps a sure one is the sure
    one again and is dropped; digits alone are no secret.

    The interval join is over cells of ``scope`` characters: every part looks at three
    rows, those of its own cell and of its neighbours, which hold the first and the last
    start of each role. So the work follows the number of parts however many meet.
    """
    sure = F.col("kind").isin(*BASE)
    document = ["doc_id", "content"]
    forward = Window.partitionBy(*document).orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1)
    backward = Window.partitionBy(*document).orderBy(F.desc("start"), F.desc("end")).rowsBetween(
        Window.unboundedPreceding, -1)
    around = found.withColumns({
        "_before": F.max(F.when(sure, F.col("end"))).over(forward),
        "_after": F.min(F.when(sure, F.col("start"))).over(backward),
    })
    overlaps = F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("_after") < F.col("end"), F.lit(False))
    alone = around.where(sure | ~overlaps).drop("_before", "_after").withColumns(
        {"role": _role(), "cell": F.floor(F.col("start") / scope)})
    alone = cut_lineage(alone, "secret-parts")

    roles = ("id", "secret", "endpoint")
    ends = [
        column
        for role in roles
        for column in (
            F.min(F.when(F.col("role") == role, F.col("start"))).alias(f"first_{role}"),
            F.max(F.when(F.col("role") == role, F.col("start"))).alias(f"last_{role}"))
    ]
    cells = alone.where("role is not null").groupBy(*document, "cell").agg(*ends)
    near = cells.withColumn("side", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).select(
        *[F.col(c).alias(f"_{c}") for c in document],
        (F.col("cell") - F.col("side")).alias("_cell"), "side",
        *[c for role in roles for c in (f"first_{role}", f"last_{role}")])
    weak = alone.where(~sure)
    met = weak.join(
        near,
        weak["doc_id"].eqNullSafe(near["_doc_id"]) & (weak["content"] == near["_content"])
        & (weak["cell"] == near["_cell"]))

    def meets(role: str) -> Column:
        start, first, last = F.col("start"), F.col(f"first_{role}"), F.col(f"last_{role}")
        return F.coalesce(
            F.when(F.col("side") == 0, first.isNotNull())
            .when(F.col("side") < 0, last >= start - scope)
            .otherwise(first <= start + scope), F.lit(False))

    complete = (
        F.when(F.col("role") == "id", meets("secret"))
        .when(F.col("role") == "secret", meets("id") | meets("endpoint"))
        .otherwise(meets("id") | meets("secret")))
    reported = met.where(complete).select(*document, "kind", "start", "end").distinct()
    return alone.where(sure).select(*document, "kind", "start", "end").unionByName(reported)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(
        F.array_sort(spans),
        lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, content, spans, base`` for every row of ``docs(doc_id, text)``.

    ``spans`` is an array of (start, rank, kind, end) with all finds, ``base`` those of the
    base kinds; ``content`` is a hash of the text, which together with doc_id names a row.
    Null and empty texts have no finds; repeated rows have the same ones; other columns are
    ignored; a table without rows gives none.
    """
    scanned = scan(docs)
    found = linked(parts(scanned), scope)
    order = F.array_position(F.array(*map(F.lit, BASE + LINKED)), F.col("kind")).cast("int")
    entry = F.struct(
        F.col("start"), order.alias("rank"), F.col("kind"), F.col("end"))
    grouped = found.groupBy(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content")
    ).agg(F.collect_list(entry).alias("_spans"))
    joined = scanned.select("doc_id", "content").join(
        grouped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")),
        "left")
    spans = F.coalesce("_spans", F.array().cast(
        "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    return joined.select("doc_id", "content", F.array_sort(spans).alias("spans")).withColumn(
        "base", F.filter("spans", lambda x: x["rank"] <= len(BASE)))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The spans of every document as counts, a digest and a list."""
    found = secret_spans(docs)
    counts = [
        F.expr(f"size(filter(base, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
        for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every find but endpoints replaced by ``mark``; n_chars follows.

    Overlapping finds are replaced as one. Rows without finds stay as they are, and so do
    all other columns.
    """
    spans = secret_spans(docs, scope).select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content"),
        F.filter("spans", lambda x: x["kind"] != "endpoint").alias("_cuts"),
    ).where(F.size("_cuts") > 0).distinct()
    merged = F.aggregate(
        F.col("_cuts"), F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(
                    F.get(done, F.size(done) - 1)["start"].alias("start"),
                    F.greatest(F.get(done, F.size(done) - 1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(
            x["start"].alias("start"), x["end"].alias("end"))))))
    cuts = cut_lineage(spans.select("_id", "_content", merged.alias("_cuts")), "secret-cuts")
    whole = docs.select(F.struct("*").alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    joined = whole.join(
        cuts, F.col("_row.doc_id").eqNullSafe(F.col("_id"))
        & (F.xxhash64(text) == F.col("_content")), "left")
    kept = F.transform(
        F.col("_cuts"),
        lambda x, i: F.substring(
            text, (F.coalesce(F.get(F.col("_cuts"), i - 1)["end"], F.lit(0)) + 1).cast("int"),
            (x["start"] - F.coalesce(F.get(F.col("_cuts"), i - 1)["end"], F.lit(0))).cast("int")))
    last = F.try_element_at("_cuts", F.lit(-1))["end"].cast("int") + 1
    tail = F.substring(text, last, F.length(text))
    clean = F.concat(F.array_join(F.concat(kept, F.array(tail)), mark))
    new = F.when(F.col("_id").isNull() & F.col("_content").isNull(), F.col("_row.text")).otherwise(
        clean)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(new.alias("text"))
        elif name == "n_chars":
            columns.append(F.when(
                F.col("_content").isNotNull(), F.length(clean).cast(docs.schema[name].dataType)
            ).otherwise(F.col("_row.n_chars")).alias(name))
        else:
            columns.append(F.col(f"_row.`{name}`").alias(name))
    return joined.select(*columns)
