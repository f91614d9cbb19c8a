"""Column lists and schemas. Everything in this module is a fixed value of the file formats."""

from __future__ import annotations

from pyspark.sql import types as T

BANDS = ["u", "g", "r", "i", "z"]

CATALOGUE_COLUMNS = [
    "specObjID", "class", "redshift", "redshiftError",
    "spectroSynFluxIvar_u", "spectroSynFluxIvar_g", "spectroSynFluxIvar_r",
    "spectroSynFluxIvar_z", "spectroSynFluxIvar_i",
    "spectroSynFlux_i", "spectroSynFlux_z", "spectroSynFlux_u", "spectroSynFlux_g",
    "plate", "mjd", "fiberid", "run2d", "objid", "ra", "dec",
    "u", "g", "r", "i", "z", "fieldID",
    "err_u", "err_g", "err_r", "err_i", "err_z",
    "petroRad_u", "petroRad_g", "petroRad_r", "petroRad_i", "petroRad_z",
    "petroRadErr_u", "petroRadErr_g", "petroRadErr_r", "petroRadErr_z", "petroRadErr_i",
]
_LONGS = {"specObjID", "objid", "fieldID"}
_INTS = {"plate", "mjd", "fiberid"}
_STRINGS = {"class", "run2d"}

RADII = [f"petroRad_{b}" for b in BANDS]
RADIUS_ERRORS = [f"petroRadErr_{b}" for b in BANDS]
MAGNITUDE_ERRORS = [f"err_{b}" for b in BANDS]
SYNTHETIC_FLUXES = ["spectroSynFlux_u", "spectroSynFlux_g", "spectroSynFlux_i", "spectroSynFlux_z"]
IVARS = [f"spectroSynFluxIvar_{b}" for b in ["u", "g", "r", "z", "i"]]

POSITIVE_COLUMNS = BANDS + MAGNITUDE_ERRORS + ["redshiftError"]

BOOKKEEPING = [
    "specObjID", "plate", "ra", "dec", "mjd", "fiberid", "run2d", "objid", "fieldID",
    "redshiftError", *IVARS, *MAGNITUDE_ERRORS,
]

CLUSTER_NO_SIZE = [
    "redshift", "spectroSynFlux_i", "spectroSynFlux_z", "spectroSynFlux_u", "spectroSynFlux_g",
    "ra", "dec", "u", "g", "r", "i", "z",
]
CLUSTER_WITH_SIZE = CLUSTER_NO_SIZE + RADII

SAMPLE_PARAMETERS = ["i", "r̄", "Mfac", "rFac", "f1", "f2", "f3", "f4", "pa", "Sα"]
SAMPLE_TAGS = ["singlePeak", "doublePeak", "rotation"]
SAMPLE_MEASURES = ["phaseAmplitude", "t_char", "rBLR", "FHWM"]
SAMPLE_SHARES = ["f1", "f2", "f3", "f4"]
CLUSTER_SAMPLES = SAMPLE_PARAMETERS + SAMPLE_MEASURES

PARAMETER_RANGES = {
    "i": (0.0, 90.0), "r̄": (500.0, 5e4), "Mfac": (0.05, 5.0), "rFac": (2.0, 100.0),
    "f1": (0.0, 1.0), "f2": (0.0, 1.0), "f3": (0.0, 1.0), "f4": (0.0, 1.0),
    "pa": (0.0, 360.0), "Sα": (-2.0, 2.0),
}

CURVE_NAMES = ["1158", "1367", "1469", "1745", "Lya", "NV", "SiIV", "CIV", "HeII"]
LIGHT_CURVE_HEADER_LINES = 30


def flux_column(name: str) -> str:
    """Flux column of a curve: numeric names get ``F``, line names ``F_``."""
    return f"F{name}" if name.isdigit() else f"F_{name}"


def _catalogue_type(name: str) -> T.DataType:
    if name in _LONGS:
        return T.LongType()
    if name in _INTS:
        return T.IntegerType()
    if name in _STRINGS:
        return T.StringType()
    return T.DoubleType()


CATALOGUE_SCHEMA = T.StructType([T.StructField(c, _catalogue_type(c)) for c in CATALOGUE_COLUMNS])

SAMPLE_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in SAMPLE_PARAMETERS]
    + [T.StructField("singlePeak", T.BooleanType()), T.StructField("doublePeak", T.BooleanType()),
       T.StructField("rotation", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in SAMPLE_MEASURES]
)

LIGHT_CURVE_COLUMNS = ["t"] + [p + flux_column(n) for n in CURVE_NAMES for p in ("", "e_")]
LIGHT_CURVE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in LIGHT_CURVE_COLUMNS])

SPECTRUM_SCHEMA = T.StructType([
    T.StructField("visit", T.StringType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("exp", T.DoubleType()),
    T.StructField("lambda", T.DoubleType()),
    T.StructField("flux", T.DoubleType()),
    T.StructField("error", T.DoubleType()),
    T.StructField("cont_flux", T.DoubleType()),
    T.StructField("model_flux", T.DoubleType()),
])
