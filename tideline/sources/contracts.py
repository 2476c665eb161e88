"""Declared table and file layouts. Nothing is inferred."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


MONTH = "stored_month"  # the directories of a daily table; rows may have no such column
MISSING = "rows lack a required value"
DECLARED = "tideline.declared"  # the table property that holds what file tables cannot enforce


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A SQL string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def enforced(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``df``, whose plan raises where a row lacks one of the ``required`` values.

    The check is part of whatever reads or writes the rows, so it costs no pass of its own.
    """
    def kept(f: T.StructField):
        if f.name not in required:
            return F.col(quoted(f.name))
        refuse = F.raise_error(F.lit(f"{MISSING}: {f.name}")).cast(f.dataType)
        return F.coalesce(F.col(quoted(f.name)), refuse).alias(f.name, metadata=f.metadata)

    absent = set(required) - set(df.columns)
    if absent:
        raise ValueError(f"no column {sorted(absent)}")
    return df.select(*[kept(f) for f in df.schema]) if required else df


@dataclass(frozen=True)
class Declaration:
    """What a catalog table promises beyond its schema."""

    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    day: str | None = None


def declaration(spark: SparkSession, table: str) -> Declaration:
    """The promises of a table made by ``TableContract.create``; none for others."""
    held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if DECLARED not in held:
        return Declaration()
    found = json.loads(held[DECLARED])
    return Declaration(tuple(found["key"]), tuple(found["required"]), found["day"])


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    required: bool = False
    comment: str = ""


@dataclass(frozen=True)
class TableContract:
    """Columns, types, required columns and key of a table."""

    columns: tuple[Column, ...]
    key: tuple[str, ...]
    comment: str = ""

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required]

    @property
    def schema(self) -> T.StructType:
        out = T.StructType()
        for c in self.columns:
            kind = T.DataType.fromDDL(c.type)
            note = {"comment": c.comment} if c.comment else None
            out = out.add(c.name, kind, not c.required, note)
        return out

    def conform(self, df: DataFrame) -> DataFrame:
        """Exactly the declared columns, in order and type. A missing one is an error."""
        return df.select(
            *[
                F.col(c.name).cast(c.type).alias(
                    c.name, metadata={"comment": c.comment} if c.comment else {}
                )
                for c in self.columns
            ]
        )

    def create(self, spark: SparkSession, table: str, by_month: str | None = None) -> None:
        """Declare the table in the catalog, with its comments, unless it exists.

        File tables take NOT NULL and keys only as a promise, so both are kept as a table
        property by which ``overwrite_table`` and ``upsert_table`` check what they
        write. ``by_month`` names the day whose months are the table's partitions.
        """
        columns = [f"{quoted(c.name)} {c.type} COMMENT {text(c.comment)}" for c in self.columns]
        placed = ""
        if by_month is not None:
            if by_month not in self.key:
                raise ValueError(f"{by_month} must be one of the keys")
            columns.append(f"{MONTH} STRING COMMENT 'month of the day, the partition'")
            placed = f"PARTITIONED BY ({MONTH})"
        promised = {"key": self.key, "required": sorted({*self.required, *self.key}), "day": by_month}
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)}) USING parquet {placed} "
            f"COMMENT {text(self.comment)} TBLPROPERTIES ({text(DECLARED)} = {text(json.dumps(promised))})"
        )


@dataclass(frozen=True)
class EnvelopeField:
    """One field of a snapshot row, and the column it becomes.

    ``factor`` converts the unit, exactly, into the column's type.
    """

    source: str
    type: str
    column: str
    column_type: str | None = None
    factor: int = 1


@dataclass(frozen=True)
class EnvelopeLayout:
    """A JSON object that holds its rows in one array."""

    fields: tuple[EnvelopeField, ...]
    date_field: str
    date_column: str = "day"
    date_format: str = "yyyy-MM-dd"
    array: str = "value"

    @property
    def row_schema(self) -> T.StructType:
        out = T.StructType().add(self.date_field, T.StringType())
        for f in self.fields:
            out = out.add(f.source, T.DataType.fromDDL(f.type))
        return out

    @property
    def schema(self) -> T.StructType:
        return T.StructType().add(self.array, T.ArrayType(self.row_schema))

    @property
    def payload(self) -> Sequence[str]:
        return [f.column for f in self.fields]


# The layout of the public daily settlement snapshots (amounts in
# thousands) and the columns of the daily table loaded from them.
SETTLEMENT_ENVELOPE = EnvelopeLayout(
    date_field="Data",
    date_column="data",
    fields=(
        EnvelopeField("Quantidade", "bigint", "quantidade"),
        EnvelopeField("CanalPrimario", "bigint", "quantidade_canal_primario"),
        EnvelopeField("CanalSecundario", "bigint", "quantidade_canal_secundario"),
        EnvelopeField("Total", "decimal(18,2)", "valor_reais", "decimal(18,2)", 1000),
        EnvelopeField("Media", "decimal(18,2)", "valor_medio_reais"),
    ),
)

SETTLEMENT_DAILY = TableContract(
    columns=(
        Column("data", "date", required=True, comment="settlement day, unique"),
        Column("quantidade", "bigint", comment="transactions settled"),
        Column("quantidade_canal_primario", "bigint", comment="NULL where not reported"),
        Column("quantidade_canal_secundario", "bigint", comment="NULL where not reported"),
        Column("valor_reais", "decimal(18,2)", comment="amount settled"),
        Column("valor_medio_reais", "decimal(18,2)", comment="mean amount"),
        Column("ano", "int"),
        Column("mes", "int"),
        Column("dia_do_mes", "int"),
        Column("dia_da_semana", "int", comment="1 = Monday ... 7 = Sunday"),
        Column("nome_dia_da_semana", "string"),
        Column("fim_de_semana", "boolean"),
    ),
    key=("data",),
    comment="one typed row per settlement day",
)

# The window calendar seed and its kinds.
WINDOW_SEED = TableContract(
    columns=(
        Column("data_inicio", "date", required=True, comment="first day, inclusive"),
        Column("data_fim", "date", required=True, comment="last day, inclusive"),
        Column("tipo", "string", required=True, comment="kind of window"),
        Column("fonte", "string", required=True, comment="where the window is published"),
        Column("observacao", "string"),
    ),
    key=("data_inicio", "tipo"),
    comment="one row per event window",
)
WINDOW_KINDS = ("data_fifa", "copa_do_mundo", "torneio_continental")
