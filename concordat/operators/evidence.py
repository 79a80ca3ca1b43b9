"""Evidence on extracted fields: schemas that hold it at any depth, and its validation.

An extraction schema is a ``StructType``. ``with_evidence`` rewrites it so that the
chosen structs - the record itself, or those inside its arrays and maps too - get an
array of evidence; ``evidence_errors`` walks the extended schema once and builds one
expression that checks every piece of evidence in the row, wherever it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StringType, StructField, StructType

# The parts of a piece of evidence and the range of its confidence.
PARTS = ("field_name", "value", "confidence", "quote", "reasoning", "source_section")
EVIDENCE = StructType([StructField(x, IntegerType() if x == "confidence" else StringType()) for x in PARTS])
LEAST, MOST = 0, 5
ERROR = "struct<field:string,raw_value:string,error_type:string,message:string,suggested_fix:string>"


def with_evidence(schema: StructType, *, deep: bool = False, name: str = "evidence") -> StructType:
    """``schema`` with an array of evidence as its last field; ``deep``: in every struct within it as well.

    A schema that has it already stays as it is; a field of that name with another type is an error.
    """
    kind = ArrayType(EVIDENCE)

    def inner(data_type: DataType) -> DataType:
        if isinstance(data_type, StructType):
            return extend(data_type)
        if isinstance(data_type, ArrayType):
            return ArrayType(inner(data_type.elementType), data_type.containsNull)
        if isinstance(data_type, MapType):
            return MapType(data_type.keyType, inner(data_type.valueType), data_type.valueContainsNull)
        return data_type

    def extend(struct: StructType) -> StructType:
        own = {f.name: f.dataType for f in struct}
        if name in own and own[name] != kind:
            raise ValueError(f"{name} is a field of type {own[name].simpleString()}")
        fields = [f if f.name == name or not deep else StructField(f.name, inner(f.dataType), f.nullable, f.metadata) for f in struct]
        return StructType(fields if name in own else [*fields, StructField(name, kind, True)])

    return extend(schema)


def without_evidence(schema: StructType, name: str = "evidence") -> StructType:
    """The schema before ``with_evidence``, at every depth."""
    def bare(data_type: DataType) -> DataType:
        if isinstance(data_type, StructType):
            return StructType([StructField(f.name, bare(f.dataType), f.nullable, f.metadata) for f in data_type
                               if not (f.name == name and f.dataType == ArrayType(EVIDENCE))])
        if isinstance(data_type, ArrayType):
            return ArrayType(bare(data_type.elementType), data_type.containsNull)
        if isinstance(data_type, MapType):
            return MapType(data_type.keyType, bare(data_type.valueType), data_type.valueContainsNull)
        return data_type

    return bare(schema)


def _error(path: Column, raw: Column, message: str, fix: str) -> Column:
    return F.struct(path.alias("field"), raw.cast("string").alias("raw_value"), F.lit("data_error").alias("error_type"),
                    F.lit(message).alias("message"), F.lit(fix).alias("suggested_fix"))


def _none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _when(condition: Column, error: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(error)).otherwise(_none())


def _piece(piece: Column, at: Column, fields: list[str] | None) -> Column:
    """Errors of one piece of evidence."""
    part = lambda x: F.concat(at, F.lit(f".{x}"))
    name, confidence = piece["field_name"], piece["confidence"]
    strange = F.lit(False) if fields is None else name.isNotNull() & ~name.isin(*fields)
    return F.concat(
        _when(piece.isNotNull() & name.isNull(), _error(part("field_name"), name, "Field required", "")),
        _when(strange, _error(part("field_name"), name, "Input should be a field of its record", "")),
        _when(confidence < LEAST, _error(part("confidence"), confidence, f"Input should be greater than or equal to {LEAST}", str(LEAST))),
        _when(confidence > MOST, _error(part("confidence"), confidence, f"Input should be less than or equal to {MOST}", str(MOST))))


def evidence_errors(value: Column, schema: StructType, *, name: str = "evidence", path: str = "", known_fields: bool = False) -> Column:
    """All errors of the evidence in a struct, as an array of (field, raw_value, error_type, message, suggested_fix).

    ``field`` is the dotted place, positions and map keys included. A piece without a
    field name, or with a confidence outside 0 to 5, is an error; with ``known_fields`` a name that is no
    field of the struct it lies in, too.
    """
    def walk(c: Column, data_type: DataType, at: Column) -> Column | None:
        if isinstance(data_type, StructType):
            found = []
            fields = [f.name for f in data_type if f.name != name]
            for f in data_type:
                below = F.concat(at, F.lit(f".{f.name}"))
                if f.name == name and f.dataType == ArrayType(EVIDENCE):
                    found.append(each(c[f.name], below, lambda p, a, own=fields: _piece(p, a, own if known_fields else None)))
                elif (inner := walk(c[f.name], f.dataType, below)) is not None:
                    found.append(inner)
            return F.concat(*found) if found else None
        if isinstance(data_type, ArrayType):
            if walk(F.lit(None), data_type.elementType, F.lit("")) is None:
                return None
            return each(c, at, lambda x, a: walk(x, data_type.elementType, a))
        if isinstance(data_type, MapType):
            if walk(F.lit(None), data_type.valueType, F.lit("")) is None:
                return None
            entries = F.transform(F.map_entries(c), lambda e: walk(e["value"], data_type.valueType, F.concat(at, F.lit("."), e["key"].cast("string"))))
            return F.coalesce(F.flatten(entries), _none())
        return None

    def each(values: Column, at: Column, check) -> Column:
        errors = F.transform(values, lambda x, i: check(x, F.concat(at, F.lit("."), i.cast("string"))))
        return F.coalesce(F.flatten(errors), _none())

    found = walk(value, schema, F.lit(path))
    trimmed = _none() if found is None else F.coalesce(found, _none())
    return F.transform(trimmed, lambda e: e.withField("field", F.ltrim(e["field"], F.lit("."))))


def parse(df: DataFrame, text: str, schema: StructType, *, name: str = "evidence", deep: bool = False) -> DataFrame:
    """``df`` with ``output`` (the extraction in ``text``, parsed with the extended schema) and ``errors`` beside it.

    Parsing and checking are one projection. Text that is not JSON gives a NULL output and one error.
    """
    extended = with_evidence(schema, deep=deep, name=name)
    broken = F.col(text).isNotNull() & F.col("output._bad").isNotNull()
    loose = StructType([*extended, StructField("_bad", StringType(), True)])
    parsed = df.withColumn("output", F.from_json(text, loose, {"columnNameOfCorruptRecord": "_bad"}))
    bad = _when(broken, _error(F.lit("output"), F.col(text), "Input should be a valid JSON object", ""))
    kept = F.when(F.col(text).isNotNull() & F.col("output._bad").isNull(), F.col("output").dropFields("_bad"))
    return parsed.withColumn("errors", F.concat(bad, F.when(broken, _none()).otherwise(
        evidence_errors(F.col("output"), extended, name=name)))).withColumn("output", kept)


def quarantine(parsed: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, one row for each error) of what ``parse`` gave."""
    good = parsed.where(F.size("errors") == 0).drop("errors")
    bad = parsed.select(F.col(row_id).alias("row_id"), F.explode("errors").alias("e")).select("row_id", "e.*")
    return good, bad
