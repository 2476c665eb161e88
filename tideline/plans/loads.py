"""Snapshots, upserts and overwrites, run on data taken from the tables.

Files go below the shared folder of the session, a new place for each run.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.numbers import MONEY, cents_sum, count_where
from tideline.operators.merge import merge_report, merge_rows
from tideline.operators.series import daily_series, with_calendar
from tideline.plans import settlements
from tideline.plans import sql as q
from tideline.plans.registry import query
from tideline.plans.tables import campaign_windows, read, shipments
from tideline.plans.windows import WINDOWS
from tideline.session import remove_folder, scratch_path
from tideline.sources import snapshots
from tideline.sources.contracts import (
    Column,
    EnvelopeField,
    EnvelopeLayout,
    TableContract,
    text,
)
from tideline.sources.seeds import read_window_seed
from tideline.sources.tables import (
    publish_version,
    read_current,
    read_daily,
    upsert_daily,
    upsert_table,
    write_daily,
)

# Raw fields are named as in the public snapshots; amounts are in thousands.
LAYOUT = EnvelopeLayout(
    date_field="Data",
    fields=(
        EnvelopeField("Quantidade", "bigint", "quantity"),
        EnvelopeField("CanalPrimario", "bigint", "quantity_primary"),
        EnvelopeField("CanalSecundario", "bigint", "quantity_secondary"),
        EnvelopeField("Total", "decimal(18,2)", "value", MONEY, 1000),
        EnvelopeField("Media", "decimal(18,2)", "mean_value"),
    ),
)
CHANNELS_SINCE = date(1998, 1, 1)
OLD_STAMP, NEW_STAMP = "2001-11-01T060000Z", "2001-11-05T060000Z"
OLD_UNTIL = date(2001, 10, 31)


def raw_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipments as an upstream system would hand them out: text dates,
    thousands, channels not reported before a date."""
    daily = daily_series(
        read(spark, sf_dir, "lineitem"),
        "l_shipdate",
        {
            "Quantidade": F.count(F.lit(1)),
            "open": count_where(F.col("l_linestatus") == "O"),
            "full": count_where(F.col("l_linestatus") == "F"),
            "amount": cents_sum("l_extendedprice"),
        },
    )
    reported = F.col("day") >= F.lit(CHANNELS_SINCE)
    return daily.select(
        F.date_format("day", "yyyy-MM-dd").alias("Data"),
        "Quantidade",
        F.when(reported, F.col("open")).alias("CanalPrimario"),
        F.when(reported, F.col("full")).alias("CanalSecundario"),
        (F.col("amount") / 1000).cast(MONEY).alias("Total"),
        (F.col("amount") / F.col("Quantidade")).cast(MONEY).alias("Media"),
    )


def landed_twice(spark: SparkSession, sf_dir: str) -> str:
    """Two snapshots: an older and shorter one, and the current one."""
    directory = scratch_path(spark, "landing")
    rolled = scratch_path(spark, "extraction")
    raw = raw_extraction(spark, sf_dir)
    raw.write.parquet(rolled)  # the facts are rolled up once for both
    raw = spark.read.schema(raw.schema).parquet(rolled)
    older = raw.filter(F.col("Data") <= OLD_UNTIL.isoformat())
    older = older.withColumn("Quantidade", F.col("Quantidade") + 1)
    snapshots.land_snapshot(older, directory, "shipments", LAYOUT, OLD_STAMP)
    snapshots.land_snapshot(raw, directory, "shipments", LAYOUT, NEW_STAMP)
    remove_folder(spark, rolled)
    return directory


RAW_SQL = f"""
    SELECT strftime(day, '%Y-%m-%d') AS "Data", quantity AS "Quantidade",
           CASE WHEN day >= DATE '{CHANNELS_SINCE}' THEN o END AS "CanalPrimario",
           CASE WHEN day >= DATE '{CHANNELS_SINCE}' THEN f END AS "CanalSecundario",
           {q.ratio('cents', '1000')} AS total, {q.ratio('cents', 'quantity')} AS mean, day
    FROM (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS quantity,
                 count(*) FILTER (WHERE l_linestatus = 'O') AS o,
                 count(*) FILTER (WHERE l_linestatus = 'F') AS f,
                 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS HUGEINT) AS cents
          FROM lineitem GROUP BY 1)"""


@query(
    f"""
    SELECT day, "Quantidade" AS quantity, "CanalPrimario" AS quantity_primary,
           "CanalSecundario" AS quantity_secondary, {q.money('total * 1000')} AS value,
           {q.money('mean')} AS mean_value, CAST(year(day) AS INTEGER) AS year,
           CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day_of_month,
           CAST(isodow(day) AS INTEGER) AS weekday,
           ['monday','tuesday','wednesday','thursday','friday','saturday','sunday'][isodow(day)]
             AS weekday_name, isodow(day) >= 6 AS weekend
    FROM ({RAW_SQL})"""
)
def snapshot_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land two snapshots, read the newest, type it."""
    directory = landed_twice(spark, sf_dir)
    return with_calendar(snapshots.ingest_snapshot(spark, directory, "shipments", LAYOUT))


@query(
    f"""
    SELECT '{NEW_STAMP}' AS snapshot, count(*) AS rows, count(*) AS distinct_dates,
           min("Data") AS first_date, max("Data") AS last_date, count(*) >= 2000 AS maybe_truncated
    FROM ({RAW_SQL})
    UNION ALL
    SELECT '{OLD_STAMP}', count(*), count(*), min("Data"), max("Data"), count(*) >= 2000
    FROM ({RAW_SQL}) WHERE day <= DATE '{OLD_UNTIL}'"""
)
def snapshot_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots, with a page cap of 2000 rows."""
    directory = landed_twice(spark, sf_dir)
    raw = snapshots.scan_snapshots(spark, f"{directory}/shipments_*", LAYOUT)
    return snapshots.snapshot_profile(raw, LAYOUT, cap=2000)


DECLARED = TableContract(
    columns=(
        Column("day", "date", required=True, comment="ship day, unique"),
        Column("quantity", "int", comment="line items shipped"),
        Column("value", "decimal(20,4)", comment="their price"),
        Column("weekday", "string"),
    ),
    key=("day",),
)


@query(
    f"""SELECT day, CAST(quantity AS INTEGER) AS quantity, CAST(value AS DECIMAL(20,4)) AS value,
               CAST(weekday AS VARCHAR) AS weekday FROM ({q.shipments()})"""
)
def declared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared columns only, in the declared order and types."""
    return DECLARED.conform(with_calendar(shipments(spark, sf_dir)))


TYPED_SQL = f"""
    SELECT day AS data, "Quantidade" AS quantidade,
           "CanalPrimario" AS quantidade_canal_primario,
           "CanalSecundario" AS quantidade_canal_secundario,
           {q.money('total * 1000')} AS valor_reais, {q.money('mean')} AS valor_medio_reais,
           CAST(year(day) AS INTEGER) AS ano, CAST(month(day) AS INTEGER) AS mes,
           CAST(day(day) AS INTEGER) AS dia_do_mes, CAST(isodow(day) AS INTEGER) AS dia_da_semana,
           ['segunda', 'terca', 'quarta', 'quinta', 'sexta', 'sabado', 'domingo'][isodow(day)]
             AS nome_dia_da_semana,
           isodow(day) >= 6 AS fim_de_semana
    FROM ({RAW_SQL})"""


@query(TYPED_SQL)
def settlement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of two snapshots under the study's own column names."""
    directory = landed_twice(spark, sf_dir)
    newest = snapshots.latest_snapshot(spark, directory, "shipments")
    return settlements.typed_daily(
        snapshots.scan_snapshots(spark, newest, settlements.SETTLEMENT_ENVELOPE)
    )


# The same figures under the names the general statements use.
SETTLED = f"""
    SELECT data AS day, quantidade AS quantity, valor_reais AS value,
           CAST(valor_reais * 100 AS HUGEINT) AS cents, dia_da_semana AS weekday,
           nome_dia_da_semana
    FROM ({TYPED_SQL})"""
WEEKLY_SQL = f"""
    SELECT day AS data, weekday AS dia_da_semana, nome_dia_da_semana, quantity AS quantidade,
           quantity_mean AS media_quantidade_4_semanas, quantity_pct AS variacao_quantidade_pct,
           value AS valor_reais, value_mean AS media_valor_reais_4_semanas,
           value_pct AS variacao_valor_reais_pct, base_weeks AS semanas_na_base
    FROM ({q.baseline(SETTLED)})"""
YEARLY_SQL = f"""
    SELECT day AS data, weekday AS dia_da_semana, nome_dia_da_semana, quantity AS quantidade,
           previous_day AS data_ano_anterior, quantity_previous AS quantidade_ano_anterior,
           quantity_yoy_pct AS variacao_yoy_quantidade_pct, value AS valor_reais,
           value_previous AS valor_reais_ano_anterior,
           value_yoy_pct AS variacao_yoy_valor_reais_pct
    FROM ({q.yearly(SETTLED)})"""


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlements.typed_daily(raw_extraction(spark, sf_dir))


@query(WEEKLY_SQL)
def settlement_weekly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlements.weekly_view(settled(spark, sf_dir))


@query(YEARLY_SQL)
def settlement_yearly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlements.yearly_view(settled(spark, sf_dir))


@query(
    f"""
    SELECT y.data, y.nome_dia_da_semana, w.variacao_quantidade_pct,
           y.variacao_yoy_quantidade_pct
    FROM ({YEARLY_SQL}) y JOIN ({WEEKLY_SQL}) w USING (data)
    WHERE w.variacao_quantidade_pct <= -10 AND y.variacao_yoy_quantidade_pct <= -10"""
)
def settlement_views_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views registered by name and joined in SQL: days down by both methods."""
    weekly, yearly = "settlement_weekly", "settlement_yearly"
    settlements.register_views(settled(spark, sf_dir), weekly, yearly)
    return spark.sql(
        f"""
        SELECT y.data, y.nome_dia_da_semana, w.variacao_quantidade_pct,
               y.variacao_yoy_quantidade_pct
        FROM {yearly} AS y JOIN {weekly} AS w USING (data)
        WHERE w.variacao_quantidade_pct <= -10 AND y.variacao_yoy_quantidade_pct <= -10"""
    )


def _database(spark: SparkSession) -> str:
    """A new database in the catalog whose tables lie in the shared folder."""
    path = scratch_path(spark, "tideline_db")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION {text(path)}")
    return name


def kept_views(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The newest snapshot in a declared table, and both views of it in the catalog."""
    database = _database(spark)
    settlements.load_table(spark, landed_twice(spark, sf_dir), "shipments", f"{database}.daily")
    views = f"{database}.weekly", f"{database}.yearly"
    settlements.create_views(spark, f"{database}.daily", *views)
    return views


@query(WEEKLY_SQL)
def settlement_kept_weekly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(kept_views(spark, sf_dir)[0])


@query(YEARLY_SQL)
def settlement_kept_yearly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(kept_views(spark, sf_dir)[1])


STORED_UNTIL, BATCH_FROM = date(2001, 1, 1), date(2000, 7, 1)
KEYS, COMPARED = ["l_returnflag", "day"], ["quantity", "value"]


def stored_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old state with other counts on Wednesdays, and a later revised batch."""
    series = shipments(spark, sf_dir, ["l_returnflag"])
    wrong = (F.weekday("day") == 2).cast("bigint")
    stored = series.filter(F.col("day") < F.lit(STORED_UNTIL)).withColumn(
        "quantity", F.col("quantity") + wrong
    )
    return stored, series.filter(F.col("day") >= F.lit(BATCH_FROM))


MERGED_SQL = f"""
    WITH s AS ({q.shipments(['l_returnflag'])}),
    t AS (SELECT * REPLACE (quantity + CASE WHEN weekday = 3 THEN 1 ELSE 0 END AS quantity)
          FROM s WHERE day < DATE '{STORED_UNTIL}'),
    b AS (SELECT * FROM s WHERE day >= DATE '{BATCH_FROM}'),
    m AS (SELECT coalesce(t.l_returnflag, b.l_returnflag) AS l_returnflag,
                 coalesce(t.day, b.day) AS day,
                 CASE WHEN t.day IS NULL THEN 'insert' WHEN b.day IS NULL THEN 'kept'
                      WHEN t.quantity IS NOT DISTINCT FROM b.quantity
                       AND t.value IS NOT DISTINCT FROM b.value THEN 'unchanged'
                      ELSE 'update' END AS action,
                 t.quantity AS tq, b.quantity AS bq, t.value AS tv, b.value AS bv
          FROM t FULL JOIN b ON t.day = b.day AND t.l_returnflag = b.l_returnflag),
    merged AS (SELECT l_returnflag, day, action,
                      CASE WHEN action IN ('insert', 'update') THEN bq ELSE tq END AS quantity,
                      CASE WHEN action IN ('insert', 'update') THEN bv ELSE tv END AS value
               FROM m)"""


@query(f"{MERGED_SQL} SELECT * FROM merged")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_rows(*stored_and_batch(spark, sf_dir), KEYS, COMPARED)


@query(f"{MERGED_SQL} SELECT action, count(*) AS rows FROM merged GROUP BY action")
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_report(merge_rows(*stored_and_batch(spark, sf_dir), KEYS, COMPARED))


@query(f"{MERGED_SQL} SELECT l_returnflag, day, quantity, value FROM merged")
def upsert_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert on a stored table, month by month."""
    stored, batch = stored_and_batch(spark, sf_dir)
    path = scratch_path(spark, "daily")
    write_daily(stored, path)
    upsert_daily(spark, batch, path, KEYS, COMPARED)
    return read_daily(spark, path, stored.schema).select(*stored.columns)


@query(f"{MERGED_SQL} SELECT action, count(*) AS rows FROM merged WHERE action <> 'kept' GROUP BY action")
def upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the upsert of the stored table says it did."""
    stored, batch = stored_and_batch(spark, sf_dir)
    path = scratch_path(spark, "daily")
    write_daily(stored, path)
    return upsert_daily(spark, batch, path, KEYS, COMPARED)


FLAGGED = TableContract(
    columns=(
        Column("l_returnflag", "string", required=True, comment="what became of the items"),
        Column("day", "date", required=True, comment="ship day"),
        Column("quantity", "bigint", required=True, comment="line items shipped"),
        Column("value", MONEY, comment="their price"),
    ),
    key=("l_returnflag", "day"),
    comment="shipments per flag and day",
)


def upserted_table(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A declared catalog table with the old state, after the upsert; and what that reports."""
    table = f"{_database(spark)}.shipped"
    FLAGGED.create(spark, table, by_month="day")
    stored, batch = (FLAGGED.conform(df) for df in stored_and_batch(spark, sf_dir))
    upsert_table(stored, table, COMPARED)
    return table, upsert_table(batch, table, COMPARED)


@query(f"{MERGED_SQL} SELECT l_returnflag, day, quantity, value FROM merged")
def upsert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert of a table by its name: old, revised and new months."""
    table, _ = upserted_table(spark, sf_dir)
    return FLAGGED.conform(spark.table(table))


@query(f"{MERGED_SQL} SELECT action, count(*) AS rows FROM merged WHERE action <> 'kept' GROUP BY action")
def upsert_catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted_table(spark, sf_dir)[1]


SEED = TableContract(
    columns=(
        Column("start_day", "date", required=True),
        Column("end_day", "date", required=True),
        Column("kind", "string", required=True),
        Column("source", "string", required=True),
    ),
    key=("start_day", "kind"),
)


@query(f"SELECT start_day, end_day, kind, source FROM ({WINDOWS})")
def overwrite_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar kept as CSV, read strictly, published twice, read back."""
    seed = scratch_path(spark, "seed")
    campaign_windows(spark, sf_dir).write.option("header", True).csv(seed)
    table = scratch_path(spark, "calendar")
    first = read_window_seed(spark, seed, SEED).filter(F.col("kind") == "1-URGENT")
    publish_version(first, table, OLD_STAMP)
    publish_version(read_window_seed(spark, seed, SEED), table, NEW_STAMP)
    return read_current(spark, table)
