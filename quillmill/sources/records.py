"""Heterogeneous records to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which files and hub exports keep the two fields.
FILE_FIELDS = (["instruction", "input", "question", "query"], ["response", "output", "answer", "completion"])
HUB_FIELDS = (FILE_FIELDS[0] + ["prompt", "text"], FILE_FIELDS[1] + ["target", "label"])
METADATA = ["source_type", "source_url", "source_file", "source_line", "collection_timestamp", "license", "author", "tags", "quality_score", "review_status"]


def quoted(name: str) -> str:
    """A column's name where a dot would be taken for a field."""
    return "`" + name.replace("`", "``") + "`"


def first_of(df: DataFrame, names: list[str], blank: bool = False) -> Column:
    """The first field that is neither null nor empty, as text; false and 0 count as empty. blank: the first empty text, if there is no other."""
    found, blanks = [], []
    for n in names:
        if n in df.columns:
            kind = df.schema[n].dataType
            of = F.col(quoted(n))
            c = of.cast("string")
            if isinstance(kind, T.NumericType):
                c = F.when(of != 0, c)
            elif isinstance(kind, T.BooleanType):
                c = F.when(of, c)
            elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
                c = F.to_json(of)
            found.append(F.nullif(c, F.lit("")))
            if blank and isinstance(kind, T.StringType):
                blanks.append(c)
    found += blanks
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def chat(messages: Column) -> tuple[Column, Column]:
    """User and assistant texts of a message list, each joined by blank lines; null unless both roles occur."""

    def of(role: str) -> Column:
        said = F.filter(messages, lambda m: m["role"] == role)
        return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda m: m["content"]), "\n\n"))

    both = (F.size(messages) >= 2) & of("user").isNotNull() & of("assistant").isNotNull()
    return F.when(both, of("user")), F.when(both, of("assistant"))


def pair(conversations: Column, element: T.DataType) -> tuple[Column, Column]:
    """The first two turns of a conversation list of structs with `value`, or of texts."""

    def turn(k: int) -> Column:
        t = F.try_element_at(conversations, F.lit(k))
        return t["value"] if isinstance(element, T.StructType) else t.cast("string")

    two = F.size(conversations) >= 2
    return F.when(two, turn(1)), F.when(two, turn(2))


def to_samples(df: DataFrame, instruction: str | None = None, response: str | None = None, hub: bool = False, incomplete: bool = False) -> DataFrame:
    """df's columns and instruction, response; rows that lack either are dropped. incomplete: they are kept, with the null or empty text they have."""
    fields = HUB_FIELDS if hub else FILE_FIELDS
    named = [instruction, *fields[0]] if instruction else fields[0], [response, *fields[1]] if response else fields[1]
    i, r = (first_of(df, names) for names in named)
    if hub and "messages" in df.columns:
        mi, mr = chat(F.col("messages"))
        i, r = F.coalesce(i, mi), F.when(i.isNull(), F.coalesce(mr, r)).otherwise(r)
    if hub and "conversations" in df.columns:
        ci, cr = pair(F.col("conversations"), df.schema["conversations"].dataType.elementType)
        i, r = F.coalesce(i, ci), F.coalesce(r, cr)
    if incomplete:
        i, r = (F.coalesce(c, first_of(df, names, blank=True)) for c, names in zip((i, r), named, strict=True))
    out = df.select(*[quoted(c) for c in df.columns if c not in ("instruction", "response")], i.alias("instruction"), r.alias("response"))
    return out if incomplete else out.where("instruction is not null and instruction != '' and response is not null and response != ''")


def hub_samples(df: DataFrame, name: str, number: str = "idx", **fields) -> DataFrame:
    """Samples of a hub export's rows, numbered by a column: id (the row's own, else name_number), address, tags, licence
    and author."""
    own = lambda c, default: F.col(c) if c in df.columns else F.lit(default)
    tags = F.col("tags").cast("array<string>") if "tags" in df.columns else F.array().cast("array<string>")
    df = df.withColumns(
        {
            "id": F.col("id").cast("string") if "id" in df.columns else F.concat(F.lit(f"{name}_"), F.col(number).cast("string")),
            "source_type": F.lit("datasetloader"),
            "source_url": F.lit(f"https://huggingface.co/datasets/{name}"),
            "tags": F.coalesce(tags, F.array().cast("array<string>")),
            "license": own("license", None).cast("string"),
            "author": own("author", None).cast("string"),
        }
    )
    return to_samples(df, hub=True, **fields)


def generated_samples(df: DataFrame, tags: tuple[str, ...] = (), keep: tuple[str, ...] = (), **metadata: Column) -> DataFrame:
    """instruction, response, the columns to keep, source_type, tags, the named metadata given, and custom_json with all other metadata."""
    custom = [c.alias(k) for k, c in metadata.items() if k not in METADATA]
    return df.select(
        "instruction",
        "response",
        *keep,
        F.lit("generated").alias("source_type"),
        F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"),
        *[c.alias(k) for k, c in metadata.items() if k in METADATA and k not in ("source_type", "tags")],
        (F.to_json(F.struct(*custom)) if custom else F.lit("{}")).alias("custom_json"),
    )


#: Types of the metadata fields, in the order of METADATA.
METADATA_TYPES = ["string", "string", "string", "int", "string", "string", "string", "array<string>", "double", "string"]


def encode(samples: DataFrame) -> DataFrame:
    """line: each sample as one JSON object, its custom metadata beside the named fields; null fields are left out."""
    named = [c for c in METADATA if c in samples.columns]
    meta = F.to_json(F.struct(*named)) if named else F.lit("{}")
    if "custom_json" in samples.columns:
        own = F.regexp_replace(F.to_json(F.try_parse_json("custom_json")), r"\A\{\}\z", "")
        own = F.when(F.startswith(own, F.lit("{")), own)
        both = F.concat(F.substring(meta, F.lit(1), F.length(meta) - 1), F.lit(","), F.substring(own, F.lit(2), F.length(own)))
        meta = F.when(own.isNull(), meta).when(meta == "{}", own).otherwise(both)
    first = [F.nullif(F.col("id").cast("string"), F.lit("")).alias("id")] if "id" in samples.columns else []
    body = F.to_json(F.struct(*first, F.coalesce("instruction", F.lit("")).alias("instruction"), F.coalesce("response", F.lit("")).alias("response")))
    return samples.select(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"metadata":'), meta, F.lit("}")).alias("line"))


def decode(lines: DataFrame) -> DataFrame:
    """Samples of JSON objects as `encode` writes them; metadata of other names goes to custom_json. Bad lines are left out."""
    fields = ", ".join(f"{c}: {t}" for c, t in zip(METADATA, METADATA_TYPES, strict=True))
    v, r = F.try_parse_json("line"), F.from_json("line", f"id string, instruction string, response string, metadata struct<{fields}>")
    own = F.map_filter(F.try_variant_get(v, "$.metadata", "map<string,variant>"), lambda k, _: ~k.isin(METADATA))
    out = lines.select(r.alias("r"), F.when(F.size(own) > 0, F.to_json(own)).alias("custom_json"), F.schema_of_variant(v).alias("s")).where("startswith(s, 'OBJECT')")
    return out.select("r.id", "r.instruction", "r.response", "r.metadata.*", "custom_json")
