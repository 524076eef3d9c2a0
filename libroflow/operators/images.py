"""Image kernels over tables of pages: image_id, height, width and the pixels as bytes, row by row.

A page is one row, so each kernel is a narrow pass in Arrow batches. Colour pages have three bytes a pixel (blue, green,
red), grey ones one. Files are read with `sources.volumes.image_files`; decoding them is left to the caller's library.

Defined edge cases: pages without pixels, or whose pixels do not fit their size, give no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from libroflow.functions import kernels

BOX = "left int, top int, right int, bottom int"


def _pages(images: DataFrame, schema: str, make: Callable[[np.ndarray], list[tuple]], colours: int = 1) -> DataFrame:
    """(image_id, ...) from what `make` gives for each page."""
    columns = ["image_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, h, w, data in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["pixels"]):
                if data is None or h is None or w is None or len(data) != h * w * colours or not len(data):
                    continue
                img = np.frombuffer(data, np.uint8).reshape((int(h), int(w), colours) if colours > 1 else (int(h), int(w)))
                rows += [(key, *x) for x in make(img)]
            yield pd.DataFrame(rows, columns=columns)

    kind = dict(images.dtypes)["image_id"]
    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, f"image_id {kind}, {schema}")


def _page(img: np.ndarray) -> tuple:
    return img.shape[0], img.shape[1], np.ascontiguousarray(img).tobytes()


_GREY = "height int, width int, pixels binary"


def pooled(images: DataFrame) -> DataFrame:
    """Grey pages with their ink on an even ground, from colour ones."""
    return _pages(images, _GREY, lambda img: [_page(kernels.without_ground(img))], 3)


def levelled(images: DataFrame) -> DataFrame:
    """Pages turned level, with the angle."""

    def make(img: np.ndarray) -> list[tuple]:
        angle = kernels.level_angle(img)
        return [(*_page(kernels.rotated(img, angle, 255)), angle)]

    return _pages(images, f"{_GREY}, angle int", make)


def strokes(images: DataFrame, least: int = 100, most: int = 50_000) -> DataFrame:
    """Boxes of the strokes of each page."""
    return _pages(images, BOX, lambda img: kernels.page_components(img, least, most))


def folios(images: DataFrame, least: int = 10_000, pad: int = 20) -> DataFrame:
    """The box of the folio on each page; pages without one give no row."""
    return _pages(images, BOX, lambda img: [box] if (box := kernels.folio_box(img, least, pad)) else [])


def signatures(images: DataFrame, least: int = 100) -> DataFrame:
    """Runs of blank rows that end an entry."""
    return _pages(images, "start int, end int", lambda img: kernels.signature_rows(img, least))


def deslanted(images: DataFrame) -> DataFrame:
    """Lines made upright, with the shear."""

    def make(img: np.ndarray) -> list[tuple]:
        shear, out = kernels.deslant(img)
        return [(*_page(out), shear)]

    return _pages(images, f"{_GREY}, shear double", make)


def binarized_pages(images: DataFrame, quantile: float = 0.1) -> DataFrame:
    """Pages whose darkest tenth is black and the rest white."""
    return _pages(images, _GREY, lambda img: [_page(np.where(img <= np.quantile(img, quantile), 0, 255).astype(np.uint8))])


def cropped(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Parts of the pages: image_id, the box, and its pixels; boxes reach no further than the page."""
    kind = dict(images.dtypes)["image_id"]
    met = images.select("image_id", "height", "width", "pixels").join(boxes.select("image_id", "left", "top", "right", "bottom"), "image_id")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, h, w, data, a, t, b, u in pdf.itertuples(index=False):
                a, t, b, u = max(0, a), max(0, t), min(w, b), min(h, u)
                if data is not None and len(data) == h * w and a < b and t < u:
                    rows.append((key, a, t, b, u, np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(h, w)[t:u, a:b]).tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "left", "top", "right", "bottom", "pixels"])

    return met.mapInPandas(run, f"image_id {kind}, {BOX}, pixels binary")
