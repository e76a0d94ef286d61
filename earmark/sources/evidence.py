"""Evidence and speaker-turn documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_REF = "array<struct<start:string,end:string,segment_ids:array<long>,label:string>>"
COLLECTIONS = {
    "chapters": "start string, end string, title string, summary string, speakers array<string>",
    "claims": f"claim string, speaker string, kind string, support string, confidence string, verification string, evidence {_REF}",
    "quotes": "text string, speaker string, start string, end string, segment_ids array<long>",
    "actions": f"action string, for_whom string, prerequisites array<string>, risks array<string>, evidence {_REF}",
    "entities": f"name string, type string, context string, evidence {_REF}",
    "glossary": f"source_term string, preferred_term string, aliases array<string>, type string, note string, evidence {_REF}",
    "visual_evidence": "timestamp string, observation string, interpretation string, confidence string",
}


def parse_collection(documents: DataFrame, name: str) -> DataFrame:
    """``episode_id, idx`` and the fields of one collection.

    ``documents``: ``episode_id, text``; only the asked collection is parsed.
    """
    fields = ", ".join(f"{f.strip().split(' ', 1)[0]}:{f.strip().split(' ', 1)[1]}" for f in _split(COLLECTIONS[name]))
    parsed = F.from_json("text", f"struct<{name}:array<struct<{fields}>>>")[name]
    return documents.select("episode_id", F.posexplode(parsed).alias("idx", "item")).select(
        "episode_id", F.col("idx").cast("long").alias("idx"), "item.*")


def _split(ddl: str) -> list[str]:
    """Fields of a DDL list, leaving nested types whole."""
    out, depth, field = [], 0, ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            out.append(field)
            field = ""
        else:
            field += char
    return [*out, field]


def parse_limitations(documents: DataFrame) -> DataFrame:
    parsed = F.from_json("text", "struct<limitations:array<string>>")["limitations"]
    return documents.select("episode_id", F.posexplode(parsed).alias("idx", "limitation"))


def parse_references(documents: DataFrame) -> DataFrame:
    """``episode_id, collection, idx, ref_no, start, end, segment_ids, label``."""
    out = None
    for name in ("claims", "actions", "entities", "glossary"):
        rows = parse_collection(documents, name).select(
            "episode_id", F.lit(name).alias("collection"), "idx", F.posexplode("evidence").alias("ref_no", "r")).select(
            "episode_id", "collection", "idx", F.col("ref_no").cast("long").alias("ref_no"), "r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def document_issues(documents: DataFrame) -> DataFrame:
    """Documents that are no object, of an unknown version, or whose
    collections are not lists (``episode_id, rule``)."""
    doc = F.try_parse_json("text")
    rows = documents.select("episode_id", doc.alias("doc"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False))
    version = F.try_variant_get("doc", "$.schema_version", "string")
    names = [*COLLECTIONS, "limitations"]
    rules = [
        F.when(~is_object, F.lit("not_an_object")),
        F.when(is_object & ~F.coalesce(version.isin("1.0", "2.0"), F.lit(False)), F.lit("schema_version")),
        *[F.when(is_object & F.try_variant_get("doc", f"$.{n}", "variant").isNotNull()
                 & F.try_variant_get("doc", f"$.{n}", "array<variant>").isNull(), F.lit(f"{n}_not_a_list")) for n in names],
    ]
    return rows.select("episode_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def glossary_labels(glossary: DataFrame) -> DataFrame:
    """Glossary rows as entries for query expansion."""
    labels = F.concat(F.array("source_term", "preferred_term"), F.coalesce("aliases", F.array().cast("array<string>")))
    return glossary.select("episode_id", F.col("idx").alias("entry"), F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != "").alias("labels"))


_TURN = "array<struct<start_seconds:double,start:double,end_seconds:double,end:double,speaker:string,label:string>>"


def parse_turns(documents: DataFrame) -> DataFrame:
    """Raw speaker turns of a list, or of an object's segments or turns."""
    listed = F.from_json("text", _TURN)
    inside = F.from_json("text", f"struct<segments:{_TURN},turns:{_TURN}>")
    some = lambda c: F.when(F.size(c) > 0, c)
    is_list = F.startswith(F.ltrim("text"), F.lit("["))
    items = F.when(is_list, listed).otherwise(F.coalesce(some(inside["segments"]), some(inside["turns"])))
    return documents.select("episode_id", F.posexplode(items).alias("turn_no", "t")).select(
        "episode_id", F.col("turn_no").cast("long").alias("turn_no"), "t.*")
