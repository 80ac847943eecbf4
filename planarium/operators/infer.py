"""Neural models as an interface: tables of images in, label maps and depths out.

A model is a function that a factory makes once in each Python worker; nothing here trains or ships one. The stubs are
deterministic and stand in for models in tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Factory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def _mapped(images: DataFrame, factory: Factory, names: list[str], kinds: str, rows: Callable[[np.ndarray], dict]) -> DataFrame:
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            for path, height, width, data in zip(batch["path"], batch["height"], batch["width"], batch["data"]):
                out = model(np.frombuffer(data, np.uint8).reshape(height, width, 3))
                row, col = np.indices(out.shape[-2:])
                yield pd.DataFrame({"path": path, "row": row.ravel(), "col": col.ravel(), **rows(out)})

    return images.select("path", "height", "width", "data").mapInPandas(step, f"path string, row int, col int, {kinds}")


def labels(images: DataFrame, factory: Factory, threshold: float = 0.5) -> DataFrame:
    """(path, row, col, label) of images (path, height, width, data): 1 + the best prompt's place where its logit's
    sigmoid is above the threshold, else 0. The model gives logits by prompt, row and column."""

    def rows(logits: np.ndarray) -> dict:
        p = 1 / (1 + np.exp(-logits))
        return {"label": np.where(p.max(0) > threshold, p.argmax(0) + 1, 0).ravel()}

    return _mapped(images, factory, ["label"], "label int", rows)


def depths(images: DataFrame, factory: Factory) -> DataFrame:
    """(path, row, col, d) of images; the model gives a depth by row and column."""
    return _mapped(images, factory, ["d"], "d double", lambda d: {"d": d.astype(float).ravel()})


def brightness_prompts(levels: int = 5) -> Callable[[np.ndarray], np.ndarray]:
    """A stub: prompt k likes brightness near k / levels."""
    middle = (np.arange(levels) + 0.5) / levels
    return lambda image: 4 - 20 * np.abs(image.mean(2)[None] / 255 - middle[:, None, None])


def row_depth() -> Callable[[np.ndarray], np.ndarray]:
    """A stub: depth grows with the distance from the image's middle row."""
    return lambda image: np.repeat(1 + np.abs(np.arange(len(image)) - len(image) / 2)[:, None] / len(image), image.shape[1], 1)
