"""Evidence: object names, envelopes, strict JSON, dedup, page sequences, links and private fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.fragments import leaks

PATH = r"^evidence/([^/]+)/(\d{4}-\d{2}-\d{2})/sha256/([0-9a-f]{2})/([0-9a-f]{64})$"
#: Identifier grammars.
GRAMMARS = {"evm_hash": "^0x[0-9a-f]{64}$", "quantity": "^0x(0|[1-9a-f][0-9a-f]*)$", "solana_signature": "^[1-9A-HJ-NP-Za-km-z]{64,88}$"}


def object_path(name: Column) -> Column:
    """source, day and digest of an evidence object's name; null for any other shape."""
    part = lambda i: F.regexp_extract(name, PATH, i)
    fits = name.rlike(PATH) & (part(3) == F.substring(part(4), 1, 2))
    return F.when(fits, F.struct(part(1).alias("source_id"), part(2).alias("day"), part(4).alias("digest")))


def read_evidence(spark, path: str) -> DataFrame:
    """Objects under a path with their names parsed and their bytes checked against the digest in the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = object_path(F.regexp_extract("path", r"(evidence/.*)$", 1))
    return files.select("path", name.alias("object"), "content").withColumn("intact", F.coalesce(F.sha2("content", 256) == F.col("object.digest"), F.lit(False)))


def unsigned(raw: Column, start: int, length: int) -> Column:
    """Big-endian number in bytes of a binary column."""
    return F.conv(F.hex(F.substring(raw, start, length)), 16, 10).cast("decimal(20,0)")


#: First bytes of an archived response, codes of chains, largest body.
RPC_MAGIC, RPC_CHAINS, RPC_BODY = b"AEMRPC1\0", {1: "ethereum", 2: "base", 3: "solana", 4: "tempo"}, 8 * 1024 * 1024


def rpc_envelope(raw: Column) -> Column:
    """Fields of an archived response; null unless magic, chain, retry marker and length are right.

    8 bytes of magic, chain (1), height (8), status (2), attempt (4), retry marker (1), retry-after (8), body length (4), body.
    """
    size, chain, marker = unsigned(raw, 33, 4), unsigned(raw, 9, 1).cast("int"), unsigned(raw, 24, 1)
    fits = (F.octet_length(raw) >= 36) & (F.substring(raw, 1, 8) == F.lit(RPC_MAGIC)) & chain.isin(*RPC_CHAINS) & marker.isin(0, 1)
    names = F.create_map(*[F.lit(x) for pair in RPC_CHAINS.items() for x in pair])
    return F.when(
        fits & (size <= RPC_BODY) & (F.octet_length(raw) == size + 36),
        F.struct(
            names[chain].alias("chain"),
            unsigned(raw, 10, 8).alias("height"),
            unsigned(raw, 18, 2).cast("int").alias("status"),
            unsigned(raw, 20, 4).cast("long").alias("attempt"),
            F.when(marker == 1, unsigned(raw, 25, 8)).alias("retry_after_ms"),
            F.substring(raw, 37, 2**31 - 37).alias("body"),
        ),
    )


def quantity(hexadecimal: Column) -> Column:
    """Value of a canonical 0x quantity of at most 64 bits; null for any other text."""
    fits = hexadecimal.rlike(GRAMMARS["quantity"]) & (F.length(hexadecimal) <= 18)
    return F.when(fits, F.conv(F.substring(hexadecimal, 3, 16), 16, 10).cast("decimal(20,0)"))


#: Error codes by which a chain says that a slot holds no block.
SKIPPED = [-32007, -32009]


def kind_at(value: Column, path: str) -> Column:
    """Type of what stands at a path of a JSON value: null where there is nothing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def decode_height(body: Column, chain: Column, requested: Column) -> Column:
    """What a JSON-RPC block response says: struct of height (null: no such block) and problem (null: none).

    EVM blocks carry their number as a canonical quantity; a Solana block has the requested slot if its fields are
    well formed and its parent is before it.
    """
    parts = F.transform(F.array(F.try_parse_json(body)), _block_parts)  # parsed once, and each part of it is looked up once
    return F.transform(parts, lambda p: _block_said(p, chain, requested))[0]


#: What is looked at in a block response: name, path.
_LOOKED = {"version": "$.jsonrpc", "id": "$.id", "result": "$.result", "error": "$.error", "number": "$.result.number", "hash": "$.result.blockhash", "before": "$.result.previousBlockhash",
           "parent": "$.result.parentSlot", "block": "$.result.blockHeight", "transactions": "$.result.transactions", "code": "$.error.code"}


def _block_parts(v: Column) -> Column:
    """Kind of each thing in a parsed response, and its text or number."""
    parts = [v.isNull().alias("none")]
    for name, path in _LOOKED.items():
        parts.append(kind_at(v, path).alias(f"{name}_kind"))
        if name in ("version", "number", "hash", "before"):
            parts.append(F.try_variant_get(v, path, "string").alias(name))
        elif name in ("id", "parent", "block", "code"):
            parts.append(F.try_variant_get(v, path, "decimal(20,0)").alias(name))
    return F.struct(*parts)


def _block_said(p: Column, chain: Column, requested: Column) -> Column:
    number = lambda name: F.when(p[f"{name}_kind"] == "BIGINT", p[name])
    result, error = p["result_kind"], p["error_kind"]
    solana = chain == "solana"
    height = quantity(F.when(p["number_kind"] == "STRING", p["number"]))
    hashes = F.lit(True)
    for name in ("hash", "before"):
        hashes &= (p[f"{name}_kind"] == "STRING") & (p[name] != "")
    parent = number("parent")
    fits = ((p["block_kind"] == "VOID") | (number("block") >= 0)) & (parent >= 0) & ((requested == 0) | (parent < requested)) & hashes & p["transactions_kind"].startswith("ARRAY")
    skipped = solana & number("code").isin(*SKIPPED)
    problem = (
        F.when(p["none"], "json")
        .when(~F.coalesce((p["version_kind"] == "STRING") & (p["version"] == "2.0"), F.lit(False)), "json-rpc version")
        .when(~F.coalesce(number("id") == 1, F.lit(False)), "json-rpc id")
        .when(result.isNotNull() & error.isNotNull(), "result and error")
        .when(error.isNotNull(), F.when(~F.coalesce(skipped, F.lit(False)), "provider error"))
        .when(result.isNull(), "result")
        .when(result == "VOID", None)
        .when(solana, F.when(~F.coalesce(fits, F.lit(False)), "solana block"))
        .when(height.isNull(), "number")
    )
    known = problem.isNull() & error.isNull() & (result != "VOID")
    return F.struct(F.when(known, F.when(solana, requested.cast("decimal(20,0)")).otherwise(height)).alias("height"), problem.alias("problem"))


def archived_success(raw: Column, chain: Column, height: Column) -> Column:
    """Whether an archived response is a 2xx answer of this chain that holds the block of this height."""
    said = lambda e: F.transform(F.array(decode_height(e["body"].cast("string"), chain, height)), lambda s: s["problem"].isNull() & (s["height"] == height))[0]
    fits = lambda e: F.when((e["chain"] == chain) & (e["height"] == height) & e["status"].between(200, 299), said(e))  # noqa: E731  # bodies of others aren't parsed
    return F.coalesce(F.transform(F.array(rpc_envelope(raw)), fits)[0], F.lit(False))


def strict_json(text: Column) -> Column:
    """Whether a text is JSON without a repeated member at any depth."""
    return F.try_parse_json(text).isNotNull()


def page_sequences(pages: DataFrame, size: int = 100) -> DataFrame:
    """Whether the pages of each crawl follow one another from 0 to the first page's total."""
    w = Window.partitionBy("crawl_id").orderBy("height")
    rows = pages.withColumn("i", F.row_number().over(w) - 1).withColumn("total", F.first("reported_total").over(w)).withColumn("last", F.lead("height").over(w).isNull())
    reaches = F.col("page_offset") + F.col("n_items") >= F.col("total")
    fine = (F.col("page_offset") == F.col("i") * size) & (F.col("reported_total") >= F.col("total")) & (F.col("last") == reaches)
    return rows.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n_pages"), F.bool_and(fine).alias("contiguous"))


def create_only(objects: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One object of each digest that isn't stored yet: its first id, size and how often it came."""
    once = objects.groupBy("digest").agg(F.min("object_id").alias("object_id"), F.max("byte_length").alias("byte_length"), F.count(F.lit(1)).alias("n_seen"))
    return once if existing is None else once.join(existing.select("digest"), "digest", "left_anti")


def links(pages: DataFrame, text: str = "html", pattern: str = r'href="([^"]*)"') -> DataFrame:
    """Each link of each page with the number of times it stands there."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n_links"))


def wiki_links(markdown: Column) -> Column:
    """Targets of [[...]]; null if brackets don't pair."""
    opened, closed = F.regexp_count(markdown, F.lit(r"\[\[")), F.regexp_count(markdown, F.lit(r"\]\]"))
    found = F.regexp_extract_all(markdown, F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1))
    return F.when((opened == closed) & (F.size(found) == opened), found)


TRANSFERS = "struct<jsonrpc:string,id:int,error:string,result:struct<transfers:array<struct<`from`:string,hash:string,blockNum:string>>,pageKey:string>>"
SIGNATURES = "struct<result:array<struct<signature:string,slot:bigint,confirmationStatus:string>>>"
#: Finality by what a history entry is said to be.
COMMITMENTS = {"finalized": "finalized", "confirmed": "confirmed", "processed": "pending"}


def history_pages(pages: DataFrame) -> DataFrame:
    """Transactions of archived history pages (page_id, chain_scope, handle, body), EVM and Solana.

    A page is valid if it is strict JSON with at most 100 transfers, all from the handle in any case, or at
    most 1000 signatures, and all its ids are well formed; an invalid page gives one row without a
    transaction. next_cursor is the page key, or the last signature of a full page.
    """
    strict = pages.select("page_id", "chain_scope", "handle", F.explode(F.array(F.when(strict_json(F.col("body")), F.col("body")))).alias("body"))  # a generator's rows are computed once
    parsed = F.struct(F.from_json("body", TRANSFERS).alias("envelope"), F.when(F.col("chain_scope") == "solana", F.from_json("body", SIGNATURES)).alias("signed"), F.get_json_object("body", "$.error").isNull().alias("fine"))
    pages = strict.select("page_id", "chain_scope", "handle", F.inline(F.array(parsed)))
    envelope = F.col("envelope")
    evm, sol = envelope["result"], F.col("signed.result")
    answered = (envelope["jsonrpc"] == "2.0") & (envelope["id"] == 1) & F.col("fine")
    commitment = F.create_map(*[F.lit(x) for pair in COMMITMENTS.items() for x in pair])
    is_sol = F.col("chain_scope") == "solana"
    moves = F.transform(evm["transfers"], lambda t: F.struct(t["hash"].alias("transaction_id"), quantity(t["blockNum"]).alias("height"), F.lit("finalized").alias("finality")))
    signed = F.transform(sol, lambda x: F.struct(x["signature"].alias("transaction_id"), x["slot"].cast("decimal(20,0)").alias("height"), F.coalesce(commitment[x["confirmationStatus"]], F.lit("pending")).alias("finality")))
    evm_fits = (F.size(evm["transfers"]) <= 100) & F.forall(
        evm["transfers"], lambda t: (F.lower(t["from"]) == F.lower(F.col("handle"))) & t["hash"].rlike(GRAMMARS["evm_hash"]) & quantity(t["blockNum"]).isNotNull()
    )
    sol_fits = (F.size(sol) <= 1000) & F.forall(sol, lambda x: x["signature"].rlike(GRAMMARS["solana_signature"]) & (x["slot"] >= 0) & (x["confirmationStatus"].isNull() | x["confirmationStatus"].isin(*COMMITMENTS)))
    valid = F.coalesce(answered & F.when(is_sol, sol_fits).otherwise(evm_fits), F.lit(False))
    cursor = F.when(is_sol, F.when(F.size(sol) == 1000, F.element_at(sol, -1)["signature"])).otherwise(evm["pageKey"])
    judged = pages.select("*", F.explode(F.array(valid)).alias("valid"))
    rows = judged.select("page_id", "chain_scope", "handle", "valid", F.when(F.col("valid"), cursor).alias("next_cursor"), F.when(F.col("valid"), F.when(is_sol, signed).otherwise(moves)).alias("found"))
    return rows.select("page_id", "chain_scope", "handle", "valid", "next_cursor", F.explode_outer("found").alias("t")).select("page_id", "chain_scope", "handle", "valid", "next_cursor", "t.transaction_id", "t.height", "t.finality")


def manifests(spark, path: str, schema: str) -> DataFrame:
    """Manifest files named by their SHA-256, parsed strictly; reason tells what is wrong with one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    names = F.from_json(F.lit("{}"), schema)
    allowed = spark.range(0).select(names.alias("m")).schema["m"].dataType.fieldNames()
    unknown = F.array_except(F.json_object_keys(text), F.array(*[F.lit(n) for n in allowed]))
    reason = (
        F.when(F.regexp_extract("path", r"([0-9a-f]{64})(?:\.json)?$", 1) != F.sha2("content", 256), "digest")
        .when(F.col("length") > 8 * 1024 * 1024, "size")
        .when(~strict_json(text), "json")
        .when(F.size(unknown) > 0, "unknown_field")
    )
    return files.select("path", reason.alias("reason"), F.when(reason.isNull(), F.from_json(text, schema)).alias("manifest"))


def projection_violations(pages: DataFrame, snapshots: DataFrame, private: list[str]) -> DataFrame:
    """Pages (page_path, snapshot_id, markdown, citations, links) that may not be published, with the reasons.

    Citations must be in the snapshot (snapshot_id, provenance_ids), links must be those of the text and name
    the page, and no private fragment (a short list) may stand in the text, plain or escaped as in JSON; an empty one stands in each.
    """
    rows = pages.join(snapshots, "snapshot_id", "left")
    shown = wiki_links(F.col("markdown"))
    cited = F.size(F.array_except("citations", F.coalesce("provenance_ids", F.array().cast("array<string>")))) > 0
    linked = ~F.coalesce(F.array_sort(F.array_distinct(shown)) == F.array_sort(F.array_distinct("links")), F.lit(False)) | ~F.array_contains("links", F.col("page_path"))
    path = ~F.col("page_path").rlike(r"^[a-z0-9][a-z0-9/_-]*$") | F.contains("page_path", F.lit("//"))
    reasons = F.filter(F.array(F.when(cited, "citation"), F.when(linked, "links"), F.when(leaks(F.col("markdown"), private), "private"), F.when(path, "path")), lambda r: r.isNotNull())
    return rows.select("page_path", reasons.alias("reasons")).where(F.size("reasons") > 0)


#: Marks around the generated part of a page.
BEGIN, END = "<!-- BEGIN GENERATED: agent-economy-projection -->", "<!-- END GENERATED: agent-economy-projection -->"


def merge_generated(existing: Column, generated: Column) -> Column:
    """A page with its generated part replaced, or added at its end; null where marks repeat, are out of order or generated."""
    count = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    at, to = F.instr(existing, BEGIN), F.instr(existing, END)
    section = F.concat(F.lit(BEGIN + "\n"), F.rtrim(generated, F.lit(" \n\t\r")), F.lit("\n" + END))
    gap = F.when((existing == "") | existing.endswith("\n\n"), "").when(existing.endswith("\n"), "\n").otherwise("\n\n")
    whole = F.concat(F.substr(existing, F.lit(1), at - 1), section, F.substr(existing, to + len(END)))
    fits = (count(existing, BEGIN) <= 1) & (count(existing, END) <= 1) & (F.instr(generated, BEGIN) == 0) & (F.instr(generated, END) == 0)
    return F.when(fits & (at == 0) & (to == 0), F.concat(existing, gap, section, F.lit("\n"))).when(fits & (at > 0) & (to > at), whole)


def manifest_hash(evidence: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of each batch's canonical JSON: evidence by height and id, observations by height, protocol and id.

    Fields are in alphabetic order. A batch is bounded (a crawl's heights), so its lists are one row each.
    """
    items = lambda df, order, names, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*sorted(names)).alias("item")))), lambda x: x["item"]).alias(name))
    e = items(evidence, ["height", "evidence_id"], ["byte_length", "evidence_id", "height", "media_type", "sha256", "storage_uri"], "evidence")
    o = items(observations, ["height", "protocol", "observation_id"], ["evidence_id", "height", "observation_hash", "observation_id", "parser_version", "protocol"], "observations")
    rows = e.join(o, keys, "left").withColumn("observations", F.coalesce("observations", F.array().cast(o.schema["observations"].dataType)))
    shown = F.struct(*sorted([*keys, "evidence", "observations"]))
    return rows.select(*keys, F.sha2(F.to_json(shown, {"ignoreNullFields": "false"}), 256).alias("output_sha256"))
