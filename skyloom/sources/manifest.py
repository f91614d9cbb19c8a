"""Work lists of image and spectrum addresses. Nothing is fetched here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: public survey services; the parameter and target file names below belong to them
IMAGE_SERVICE = "http://skyserver.sdss.org/dr18/SkyServerWS/ImgCutout/getjpeg"
PREVIEW_SERVICE = "https://skyserver.sdss.org/dr18/en/get/specById.ashx"
SPECTRUM_SERVICE = "http://dr18.sdss.org/optical/spectrum/view/data"


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _entry(kind: str, fmt: str, opt: str, width: int, height: int, scale: float, spec: str) -> Column:
    """Address and target file of one kind."""
    if kind == "image":
        url = F.concat(F.lit(IMAGE_SERVICE + "?ra="), _text("ra"), F.lit("&dec="), _text("dec"),
                       F.lit(f"&width={width}&height={height}&scale={scale}&opt={opt}"))
        target = F.concat(F.lit("images/image_"), _text("specObjID"), F.lit(".jpeg"))
    elif fmt == "png":
        url = F.concat(F.lit(PREVIEW_SERVICE + "?ID="), _text("specObjID"))
        target = F.concat(F.lit("spectra/spectrum_"), _text("specObjID"), F.lit(".png"))
    else:
        url = F.concat(F.lit(f"{SPECTRUM_SERVICE}/format={fmt}/spec={spec}?plateid="), _text("plate"), F.lit("&mjd="), _text("mjd"),
                       F.lit("&fiberid="), _text("fiberid"), F.lit("&reduction2d="), _text("run2d"))
        target = F.concat(F.lit("spectra/spectrum_"), _text("specObjID"), F.lit(f".{fmt}"))
    return F.struct(url.alias("url"), target.alias("target"))


def retrieval_manifests(df: DataFrame, kinds: Sequence[tuple[str, str]] = (("image", "png"),), *, opt: str = "GL", width: int = 512,
                        height: int = 512, scale: float = 0.4, spec: str = "lite") -> DataFrame:
    """``specObjID``, address and target file per object and ``(kind, format)``, from one pass over the objects."""
    entries = F.array(*[_entry(kind, fmt, opt, width, height, scale, spec) for kind, fmt in kinds])
    return df.select("specObjID", F.explode(entries).alias("_e")).select("specObjID", "_e.url", "_e.target")
