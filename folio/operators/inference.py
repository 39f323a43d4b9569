"""Image models on pages: a model is an artifact in the shared folder, which each worker loads once, when it first needs it."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import raster as R
from folio.sources.shared import new_path

#: An image (height, width, 3) to values of classes (height, width, classes).
Predict = Callable[[np.ndarray], np.ndarray]
_LOADED: dict[str, Predict] = {}


def save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], name: str = "model") -> str:
    """Arrays as an artifact in the shared folder; plain numbers, nothing that is run when it is read."""
    path = new_path(spark, name) + ".npz"
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    data = io.BytesIO()
    np.savez(data, **arrays)
    own = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data.getvalue())
    store.move(own, place)
    return path


def _model(path: str, build: Callable[[dict[str, np.ndarray]], Predict]) -> Predict:
    if path not in _LOADED:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_file(place) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as arrays:
            _LOADED.clear()  # one model a worker
            _LOADED[path] = build(dict(arrays))
    return _LOADED[path]


def pixel_classifier(arrays: dict[str, np.ndarray]) -> Predict:
    """A linear model of single pixels: ``weights`` (3, classes) and ``bias`` (classes)."""
    weights, bias = arrays["weights"], arrays["bias"]
    return lambda image: image.astype(float) @ weights + bias


def predicted_images(images: DataFrame, path: str, colours: list[tuple[int, int, int]], build: Callable[[dict[str, np.ndarray]], Predict] = pixel_classifier, png: str = "png") -> DataFrame:
    """``images`` with ``png`` replaced by the likeliest class's colour at each pixel, and ``error``.

    A null image stays null. What can't be read or predicted is a row with its error and no image; others go on. A model
    that can't be loaded stops the job.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            predict = _model(path, build)
            at = b.schema.get_field_index(png)
            found, errors = [], []
            for data in b.column(at).to_pylist():
                out, error = None, None
                if data is not None:
                    try:
                        values = predict(R.decode_png(data))
                        if values.shape[-1] != len(colours):
                            raise ValueError(f"{values.shape[-1]} classes, {len(colours)} colours")
                        out = R.encode_png(R.likeliest_colours(values, colours))
                    except Exception as e:  # whatever is wrong with one image is its row's error
                        error = f"{type(e).__name__}: {e}"
                found.append(out)
                errors.append(error)
            yield b.set_column(at, png, pa.array(found, pa.binary())).append_column("error", pa.array(errors, pa.string()))

    return images.mapInArrow(rows, images.withColumn("error", F.lit(None).cast("string")).schema)
