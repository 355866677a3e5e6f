"""Payment offers read from protocol documents: raw HTTP, well-known, OpenAPI and catalog snapshots.

A document is taken or refused as a whole: one row with the reason says that it was refused. Only in catalog snapshots is an offer
with wrong token metadata or a field that can't be observed set aside alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.amounts import fits_u128, parses_u128
from corvane.operators.evidence import kind_at, strict_json

#: The stable coin whose name is checked, and its network and name.
NAMED_ASSET, NAMED_NETWORK, ASSET_NAME = "0x833589fcd6edb6e08f4c7c32d4f71b54bda02913", "eip155:8453", "USD Coin"
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
OFFER = "struct<scheme:variant,network:variant,amount:variant,maxAmountRequired:variant,asset:variant,payTo:variant,resource:variant,extra:variant>"
PAYMENT = f"struct<x402Version:variant,accepts:array<{OFFER}>>"
OPENAPI_VERSION = r"^3\.[01]\.(0|[1-9][0-9]*)$"
ROW = ["evidence_id", "evidence_kind", "resource", "protocol_version", "scheme", "network", "asset", "amount_atomic", "pay_to", "reason"]


def _once(column: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.transform(F.array(column), f)[0]


def _text(v: Column) -> Column:
    """The text of a JSON string; null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _absent(v: Column) -> Column:
    return v.isNull() | (F.schema_of_variant(v) == "VOID")


def _optional(v: Column) -> Column:
    """Whether a member may stand there as an optional text."""
    return _absent(v) | (F.schema_of_variant(v) == "STRING")


def _payment(json: Column, twice: bool = False) -> Column:
    """A payment document: problem (null: none), version and offers.

    Its version is 1 or 2, it has offers, and their members are of the right kind. Version 1 asks for an amount by
    maxAmountRequired alone, version 2 by amount alone; `twice` lets version 2 say the same amount in both.
    """
    return _once(F.from_json(json, PAYMENT), lambda d: _payment_said(d, twice))


def _payment_said(d: Column, twice: bool) -> Column:
    version = F.when(F.schema_of_variant(d["x402Version"]) == "BIGINT", F.try_variant_get(d["x402Version"], "$", "bigint"))

    def right_kinds(o: Column) -> Column:
        fits = _optional(o["amount"]) & _optional(o["maxAmountRequired"]) & _optional(o["resource"])
        for c in ("scheme", "network", "asset", "payTo"):
            fits &= F.coalesce(F.schema_of_variant(o[c]) == "STRING", F.lit(False))
        name = kind_at(o["extra"], "$.name")
        return fits & (_absent(o["extra"]) | (F.schema_of_variant(o["extra"]).startswith("OBJECT") & (name.isNull() | name.isin("VOID", "STRING"))))

    def amount(o: Column) -> Column:
        one, most = _text(o["amount"]), _text(o["maxAmountRequired"])
        both = one.isNotNull() & o["maxAmountRequired"].isNotNull() & F.coalesce(one == most, F.lit(False))
        in_two = F.when(_absent(o["maxAmountRequired"]) & (F.lit(not twice) | o["maxAmountRequired"].isNull()), one)
        return F.when(version == 1, F.when(_absent(o["amount"]), most)).otherwise(F.when(both, one).otherwise(in_two) if twice else in_two)

    said = F.transform(
        d["accepts"],
        lambda o: F.struct(
            *[_text(o[c]).alias(c) for c in ("scheme", "network", "asset", "payTo", "resource")], amount(o).alias("amount"), F.try_variant_get(o["extra"], "$.name", "string").alias("name")
        ),
    )
    problem = (
        F.when(version.isNull() | ~version.between(0, 2**32 - 1) | d["accepts"].isNull() | ~F.forall(d["accepts"], lambda o: F.coalesce(right_kinds(o), F.lit(False))), "malformed")
        .when(~version.isin(1, 2), "unsupported_version")
        .when(F.size(d["accepts"]) == 0, "missing_accepts")
        .when(F.exists(said, lambda o: o["amount"].isNull()), "malformed")
    )
    return F.struct(F.when(d.isNull(), "malformed").otherwise(problem).alias("problem"), version.cast("int").alias("version"), said.alias("offers"))


def _wrong(resource: Column, o: Column) -> Column:
    """Why an offer can't be observed; null if it can."""
    named = (F.lower(o["asset"]) == NAMED_ASSET) & (o["network"] == NAMED_NETWORK)
    empty = F.coalesce(F.trim(resource) == "", F.lit(True))
    for c in ("network", "asset", "payTo"):
        empty |= F.trim(o[c]) == ""
    return F.when(named & ~F.coalesce(o["name"] == ASSET_NAME, F.lit(False)), "invalid_token_metadata").when(~parses_u128(o["amount"]), "invalid_amount").when(empty, "malformed")


def _observed(docs: DataFrame, kind: str, documents: Column, problem: Column) -> DataFrame:
    """Rows of documents (array of resource and payment, see _payment) unless there is a problem with any of them."""
    exact = F.flatten(
        F.transform(
            "documents",
            lambda d: F.transform(F.filter(d["payment"]["offers"], lambda o: o["scheme"] == "exact"), lambda o: F.struct(F.coalesce(o["resource"], d["resource"]).alias("resource"), d["payment"]["version"].alias("version"), o.alias("offer"))),
        )
    )
    rows = docs.select("evidence_id", F.lit(kind).alias("evidence_kind"), problem.alias("problem"), documents.alias("documents"))
    first = F.get(F.filter(F.transform("documents", lambda d: d["payment"]["problem"]), lambda p: p.isNotNull()), F.lit(0))
    rows = rows.withColumn("problem", F.coalesce("problem", first)).withColumn("offers", F.when(F.col("problem").isNull(), exact))
    rows = rows.withColumn("offers", F.transform("offers", lambda x: F.struct(x["resource"].alias("resource"), x["version"].alias("version"), x["offer"].alias("offer"), _wrong(x["resource"], x["offer"]).alias("reason"))))
    if kind != "catalog":
        rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.size("offers") == 0, "unsupported_scheme"), F.get(F.filter(F.transform("offers", lambda x: x["reason"]), lambda p: p.isNotNull()), F.lit(0))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("resource"), F.lit(None).cast("int").alias("version"), F.lit(None).cast(rows.schema["offers"].dataType.elementType["offer"].dataType).alias("offer"), F.col("problem").alias("reason")))
    x = rows.select("evidence_id", "evidence_kind", F.explode(F.when(F.col("problem").isNotNull(), none).otherwise(F.col("offers"))).alias("x"))
    o = F.col("x.offer")
    return x.select(
        "evidence_id", "evidence_kind", "x.resource", F.col("x.version").alias("protocol_version"), o["scheme"].alias("scheme"), o["network"].alias("network"), o["asset"].alias("asset"),
        o["amount"].alias("amount_atomic"), o["payTo"].alias("pay_to"), "x.reason",
    )


def _one(docs: DataFrame, kind: str, json: Column, problem: Column) -> DataFrame:
    """Rows of documents that are one payment document each, of their endpoint unless an offer names its own resource."""
    problem = F.coalesce(problem, F.when(~F.coalesce(strict_json(json), F.lit(False)), "malformed"))
    return _observed(docs, kind, F.array(F.struct(F.col("endpoint").alias("resource"), _payment(json).alias("payment"))), problem)


def split_http(content: Column) -> Column:
    """head and body of a raw response, parted at its first blank line (CRLF, else LF); null without one."""
    text = content.cast("string")
    cut = lambda mark: F.struct(F.substring_index(text, mark, 1).alias("head"), F.substr(text, F.instr(text, mark) + len(mark)).alias("body"))
    return F.when(F.instr(text, "\r\n\r\n") > 0, cut("\r\n\r\n")).when(F.instr(text, "\n\n") > 0, cut("\n\n"))


def runtime(docs: DataFrame) -> DataFrame:
    """Raw 402 responses (evidence_id, endpoint, content): the document of version 2 is in the header, that of version 1 in the body.

    Status lines of HTTP/1.0 and 1.1 with code and reason count. A body of version 2 without a header, a header of another version,
    one that isn't base64, and two headers with a value are refused.
    """
    parts = split_http(F.col("content"))
    lines = F.split(parts["head"], r"\r?\n")
    rest = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(0))), lambda x: F.lower(F.substring_index(x, ":", 1)).eqNullSafe(F.lit("payment-required")) & F.contains(x, F.lit(":")))
    rows = docs.select("evidence_id", "endpoint", parts["body"].alias("body"), F.get(lines, F.lit(0)).alias("status"), F.filter(F.transform(rest, lambda x: F.trim(F.substr(x, F.instr(x, ":") + 1))), lambda v: v != "").alias("values"))
    header = F.try_to_binary(F.get("values", F.lit(0)), F.lit("base64")).cast("string")
    rows = rows.withColumn("json", F.when(F.size("values") == 1, header).otherwise(F.col("body")))
    version = F.try_variant_get(F.try_parse_json("json"), "$.x402Version", "bigint")
    problem = (
        F.when(~F.coalesce(F.col("status").rlike(r"^HTTP/1\.[01] 402 "), F.lit(False)), "invalid_runtime_response")
        .when((F.size("values") > 1) | ((F.size("values") == 1) & header.isNull()), "missing_payment_required")
        .when(_payment(F.col("json"))["problem"].isNotNull() | ~strict_json(F.col("json")), None)  # said by the document itself
        .when((F.size("values") == 1) & (version != 2), "unsupported_version")
        .when((F.size("values") == 0) & (version == 2), "missing_payment_required")
    )
    return _one(rows, "runtime", F.col("json"), problem)


def well_known(docs: DataFrame) -> DataFrame:
    """Documents (evidence_id, endpoint, content) of an endpoint."""
    return _one(docs, "well_known", F.col("content").cast("string"), F.lit(None).cast("string"))


def openapi(docs: DataFrame) -> DataFrame:
    """Each path and lower-case method with an x-x402 extension; the resource is the endpoint and the path.

    The document must be of version 3.0 or 3.1, its paths objects, and all its extensions payment documents.
    """
    text = F.col("content").cast("string")
    parsed = docs.select("evidence_id", "endpoint", text.alias("text"), F.from_json(text, "struct<openapi:variant,paths:map<string,variant>>").alias("d"))
    at = F.rtrim(F.col("endpoint"), F.lit("/"))
    extensions = lambda k, v: F.filter(F.array(*[F.struct(F.concat(at, k).alias("resource"), F.try_variant_get(v, f"$.{m}['x-x402']", "variant").alias("x")) for m in sorted(METHODS)]), lambda e: e["x"].isNotNull())
    documents = F.transform(F.flatten(F.transform(F.map_entries("d.paths"), lambda e: extensions(e["key"], e["value"]))), lambda e: F.struct(e["resource"].alias("resource"), _payment(F.to_json(e["x"])).alias("payment")))
    rows = parsed.select("*", documents.alias("found"))
    objects = F.forall(F.map_values("d.paths"), lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    right = strict_json(F.col("text")) & _text(F.col("d.openapi")).rlike(OPENAPI_VERSION) & F.col("d.paths").isNotNull() & objects
    problem = F.when(~F.coalesce(right, F.lit(False)), "malformed").when(F.size("found") == 0, "missing_accepts")
    return _observed(rows, "openapi", F.col("found"), problem)


def catalog(docs: DataFrame) -> DataFrame:
    """Items of catalog snapshots, each with its offers; an item that is malformed refuses its snapshot."""
    text = F.col("content").cast("string")
    items = F.from_json(text, "struct<items:array<variant>>")["items"]
    rows = docs.select("evidence_id", text.alias("text"), items.alias("items"))
    own = lambda i: F.try_variant_get(i, "$.resource", "variant")
    nameless = F.exists("items", lambda i: F.coalesce(F.trim(_text(own(i))) == "", F.lit(True)))
    found = F.transform("items", lambda i: F.struct(_text(own(i)).alias("resource"), _payment(F.to_json(i), twice=True).alias("payment")))
    problem = F.when(~F.coalesce(strict_json(F.col("text")), F.lit(False)) | F.col("items").isNull() | nameless, "malformed")
    return _observed(rows, "catalog", found, problem)


ADAPTERS = {"runtime": runtime, "well_known": well_known, "openapi": openapi, "catalog": catalog}


def accepted(observed: DataFrame) -> DataFrame:
    return observed.where("reason IS NULL").drop("reason")


def quarantined(observed: DataFrame) -> DataFrame:
    return observed.where("reason IS NOT NULL").select("evidence_id", "evidence_kind", "reason")


def mpp_offers(docs: DataFrame) -> DataFrame:
    """Offers of OpenAPI documents with x-payment-info; one bad offer rejects its whole document."""
    text = F.col("content").cast("string")
    parsed = F.when(strict_json(text), F.from_json(text, "struct<openapi:string,info:struct<title:string,version:string>,paths:map<string,map<string,string>>>"))
    one = docs.select("evidence_id", parsed.alias("d")).select("evidence_id", F.col("d.openapi").alias("openapi_version"), F.col("d.info.title").alias("service_title"), F.col("d.info.version").alias("api_version"), F.explode("d.paths").alias("path", "ops"))
    one = one.select("*", F.explode("ops").alias("http_method", "operation")).where(F.lower("http_method").isin(*METHODS))
    info = F.get_json_object("operation", "$['x-payment-info']")
    many = F.from_json(F.get_json_object(info, "$.offers"), "array<string>")
    rows = one.withColumn("info", info).where("info IS NOT NULL").withColumn("paid", F.get_json_object("operation", "$.responses['402']").isNotNull())
    rows = rows.withColumn("raw", F.explode(F.when(F.get_json_object("info", "$.offers").isNotNull(), many).otherwise(F.array("info"))))
    rows = rows.withColumn("offer", F.from_json("raw", "struct<intent:string,method:string,amount:string,currency:string,description:string>"))
    allowed = F.size(F.array_except(F.json_object_keys("raw"), F.array(*[F.lit(x) for x in ("intent", "method", "amount", "currency", "description")]))) == 0
    amount = F.col("offer.amount")
    good = F.col("paid") & allowed & F.col("offer.intent").isin("charge", "session") & (F.trim("offer.method") != "") & (amount.isNull() | fits_u128(amount))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    fine = rows.groupBy("evidence_id").agg(F.bool_and("good").alias("fine")).where("fine").select("evidence_id")
    kept = rows.join(fine, "evidence_id", "left_semi")
    return kept.select("evidence_id", "openapi_version", "service_title", "api_version", "path", "http_method", "offer.*", "raw")
