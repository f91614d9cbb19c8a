"""Catalogue, model-sample, curve, spectrum and profile tables derived from the given tables.

Every binding exists as a DataFrame and as the SQL text of the same columns.
Expressions are integer arithmetic followed by one division, which all engines
evaluate to the same double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..session import scratch_path

DAY_MICROS = 86400000000
HOUR_MICROS = 3600000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(numerator: str, divisor: int) -> str:
    return f"CAST({numerator} AS DOUBLE) / {divisor}"


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_CLASS = "CASE o_orderstatus WHEN 'F' THEN 'QSO' WHEN 'O' THEN 'GALAXY' ELSE 'STAR' END"

CATALOGUE = {
    "specObjID": "o_orderkey",
    "class": _CLASS,
    "redshift": f"CASE o_orderstatus WHEN 'F' THEN {_d('1200 + cents % 2011', 1000)} "
                f"WHEN 'O' THEN {_d('cents % 1409', 1000)} ELSE {_d('cents % 89', 10000)} END",
    "redshiftError": _d("cents * 7 % 193", 10000),
    **{f"spectroSynFluxIvar_{b}": _d(f"1 + cents * {m} % 997", 10) for b, m in zip("ugrzi", (3, 5, 11, 19, 41))},
    **{f"spectroSynFlux_{b}": _d(f"cents * {m} % 4001", 100) for b, m in zip("izug", (17, 43, 47, 53))},
    "plate": "CAST(266 + o_custkey % 3000 AS INT)",
    "mjd": "CAST(51578 + o_orderkey % 4000 AS INT)",
    "fiberid": "CAST(1 + o_orderkey % 640 AS INT)",
    "run2d": "CASE WHEN o_orderkey % 2 = 0 THEN '26' ELSE '103' END",
    "objid": "1237645876861272000 + o_orderkey",
    "ra": _d("o_orderkey * 7919 % 360000", 1000),
    "dec": _d("o_orderkey * 104729 % 180000 - 90000", 1000),
    **{b: f"CASE o_orderstatus WHEN 'P' THEN {_d(f'300 + cents * {m} % 2503', 100)} ELSE {_d(f'cents * {m} % 2503', 100)} END"
       for b, m in zip("ugriz", (23, 29, 31, 37, 59))},
    "fieldID": "o_custkey",
    **{f"err_{b}": _d(f"cents * {m} % 211", 1000) for b, m in zip("ugriz", (61, 67, 71, 73, 79))},
    **{f"petroRad_{b}": _d(f"cents * {m} % 1499", 100) for b, m in zip("ugriz", (83, 89, 97, 101, 103))},
    **{f"petroRadErr_{b}": _d(f"cents * {m} % 400 - 30", 100) for b, m in zip("ugrzi", (107, 109, 113, 127, 131))},
}

SAMPLES = {
    "row_id": "o_orderkey",
    **{name: f"{lo} + {hi - lo} * ({_d(f'cents * {m} % 10007', 10007)})"
       for (name, (lo, hi)), m in zip(S.PARAMETER_RANGES.items(), (3, 5, 7, 11, 13, 17, 19, 23, 29, 31))},
    "singlePeak": "cents % 3 = 0",
    "doublePeak": "cents % 3 = 1",
    "rotation": "CASE WHEN cents % 2 = 0 THEN 'cw' ELSE 'ccw' END",
    "phaseAmplitude": _d("cents * 37 % 5003", 10),
    "t_char": _d("cents * 41 % 7001", 1),
    "rBLR": _d("cents * 43 % 9001", 1),
    "FHWM": _d("300 * (1 + cents * 47 % 17)", 1),
}



def _derive(orders: DataFrame, columns: dict[str, str]) -> DataFrame:
    base = orders.withColumn("cents", F.expr(_CENTS))
    return base.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def _derive_sql(columns: dict[str, str]) -> str:
    chosen = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"SELECT {chosen} FROM (SELECT *, {_CENTS} AS cents FROM orders)"


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _written(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """The derived table, written to the shared folder once per application.

    The operators then see what they see in production, a stored table whose
    columns are pruned and whose filters reach the scan, and not the arithmetic
    of the derivation repeated in every expression.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    derived = _derive(table(spark, sf_dir, "orders"), columns)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        derived.write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.schema(derived.schema).parquet(_WRITTEN[key])


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 41 catalogue columns derived from ``orders`` (one object per order)."""
    return _written(spark, sf_dir, "catalogue", CATALOGUE)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged model samples derived from ``orders``."""
    return _written(spark, sf_dir, "samples", SAMPLES)


CATALOGUE_SQL = _derive_sql(CATALOGUE)
SAMPLES_SQL = _derive_sql(SAMPLES)

_POSITIVE = " AND ".join(f'"{c}" > 0' for c in S.POSITIVE_COLUMNS)
MASKED_SQL = f"SELECT * FROM cat WHERE {_POSITIVE}"


def with_micros(events: DataFrame) -> DataFrame:
    """Events with microseconds since 2024-01-01 and the value in cents."""
    return events.withColumns({
        "us": F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)"),
        "c": F.expr("CAST(round(value * 100) AS BIGINT)"),
    })


MICROS_SQL = ("SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us, "
              "CAST(round(value * 100) AS BIGINT) AS c FROM events")

_FLUX = "CAST(sum(c) AS DOUBLE) / count(*) / 100"
_SPREAD = ("sqrt(greatest(CAST(0 AS DOUBLE), CAST(sum(c * c) AS DOUBLE) / count(*) "
           "- CAST(sum(c) AS DOUBLE) / count(*) * (CAST(sum(c) AS DOUBLE) / count(*)))) / 100")
_ERROR = f"(1 + {_SPREAD}) / sqrt(CAST(count(*) AS DOUBLE))"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly light curves ``(series_id, t, flux, error)``: one per event type, t in days."""
    ev = with_micros(table(spark, sf_dir, "events"))
    return (ev.groupBy(F.col("event_type").alias("series_id"), F.floor(F.col("us") / HOUR_MICROS).alias("h"))
            .agg(F.expr(_FLUX).alias("flux"), F.expr(_ERROR).alias("error"))
            .select("series_id", (F.col("h").cast("double") / 24).alias("t"), "flux", "error"))


CURVES_SQL = (f"SELECT series_id, CAST(h AS DOUBLE) / 24 AS t, flux, error FROM (SELECT event_type AS series_id, "
              f"us // {HOUR_MICROS} AS h, {_FLUX} AS flux, {_ERROR} AS error FROM ({MICROS_SQL}) GROUP BY 1, 2)")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spectrum per day: wavelength from the ten-minute slot of the day."""
    ev = with_micros(table(spark, sf_dir, "events"))
    day = F.floor(F.col("us") / DAY_MICROS)
    slot = F.floor((F.col("us") - day * DAY_MICROS) / 600000000)
    return (ev.select(day.alias("day"), slot.alias("slot"), "c")
            .groupBy("day", "slot").agg(F.expr(_FLUX).alias("flux"), F.expr(_ERROR).alias("error"), F.count("*").alias("n"))
            .select(F.format_string("visit_%d", "day").alias("visit"), F.col("day").cast("double").alias("t"),
                    F.col("n").cast("double").alias("exp"), (F.lit(1450.0) + 2 * F.col("slot")).alias("lambda"),
                    "flux", "error", F.lit(1.0).alias("cont_flux"), (F.col("flux") - 1.0).alias("model_flux")))


SPECTRA_SQL = (f"SELECT 'visit_' || day AS visit, CAST(day AS DOUBLE) AS t, CAST(n AS DOUBLE) AS exp, "
               f"CAST(1450 + 2 * slot AS DOUBLE) AS \"lambda\", flux, error, CAST(1 AS DOUBLE) AS cont_flux, flux - 1 AS model_flux "
               f"FROM (SELECT us // {DAY_MICROS} AS day, (us % {DAY_MICROS}) // 600000000 AS slot, {_FLUX} AS flux, "
               f"{_ERROR} AS error, count(*) AS n FROM ({MICROS_SQL}) GROUP BY 1, 2)")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted points per model (user): frequency ``x`` in [0, 1), intensity, delay and phase."""
    ev = with_micros(table(spark, sf_dir, "events"))
    return ev.select(
        F.col("user_id").alias("model_id"),
        ((F.col("us") % DAY_MICROS).cast("double") / DAY_MICROS).alias("x"),
        F.col("c").cast("double").alias("intensity"),
        (F.floor(F.col("us") / DAY_MICROS).cast("double") + 0.5).alias("delay"),
        ((F.col("c") % 199 - 99).cast("double") * F.col("c")).alias("phase_weight"))


RAYS_SQL = (f"SELECT user_id AS model_id, CAST(us % {DAY_MICROS} AS DOUBLE) / {DAY_MICROS} AS x, CAST(c AS DOUBLE) AS intensity, "
            f"CAST(us // {DAY_MICROS} AS DOUBLE) + 0.5 AS delay, CAST(c % 199 - 99 AS DOUBLE) * c AS phase_weight FROM ({MICROS_SQL})")


def keyed_hash_sql(key: str, seed: int | str) -> str:
    """SQL text of the keyed 60-bit hash; ``key`` may be several expressions with commas between."""
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {key})), 1, 15)) AS BIGINT)"


def uniform_sql(key: str, seed: int | str) -> str:
    return f"((CAST({keyed_hash_sql(key, seed)} >> 8 AS DOUBLE) + 0.5) / {1 << 52}.0::DOUBLE)"


def gaussian_sql(key: str, seed: int | str) -> str:
    return (f"(sqrt(-2 * ln({uniform_sql(key, f'{seed}/radius')})) "
            f"* cos(6.283185307179586::DOUBLE * {uniform_sql(key, f'{seed}/angle')}))")


def with_sql(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in ctes.items()) + " " + body
