"""Copies, deletions and conversions on the executors; each can be repeated without harm."""

from __future__ import annotations

import os
import shutil
import subprocess
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..errors import ConversionFailed, EncoderNotAvailable
from ..runtime import ship, spread

Encoder = Callable[[str, str, int], None]


def _new_file(target: str, make: Callable[[str], None]) -> str:
    """`skipped` if the target is there; else make a temporary file beside it and rename it: `copied`; `failed` on an error."""
    if os.path.exists(target):
        return "skipped"
    temp = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}{os.path.splitext(target)[1]}"
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        make(temp)
        os.replace(temp, target)
    except (OSError, ConversionFailed):
        if os.path.exists(temp):
            os.remove(temp)
        return "failed"
    return "copied"


def _run(plan: DataFrame, act: Callable[[str, str], str], files_each: int = 500) -> DataFrame:
    ship(plan.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(status=[act(s, t) for s, t in zip(frame["source"], frame["target"], strict=True)])

    return spread(plan, files_each).mapInPandas(work, ", ".join(f"`{n}` {t}" for n, t in plan.dtypes) + ", status string")


def copy_files(plan: DataFrame) -> DataFrame:
    """`plan` (source, target, ...) with status copied, skipped (the target exists) or failed."""
    return _run(plan, lambda s, t: _new_file(t, lambda temp: shutil.copyfile(s, temp) and None))


def delete_files(plan: DataFrame) -> DataFrame:
    """`plan` (target, ...) with status removed or missing."""

    def act(_: str, target: str) -> str:
        try:
            os.remove(target)
        except OSError:
            return "missing"
        return "removed"

    return _run(plan.withColumn("source", plan["target"]), act)


def find_encoder() -> Encoder:
    """The converter of this machine; raises EncoderNotAvailable."""
    for name in ("sips", "heif-enc"):
        if shutil.which(name):
            return lambda source, target, quality: encode_with(name, source, target, quality)
    raise EncoderNotAvailable("no HEIC encoder (sips, heif-enc) is installed")


def encode_with(name: str, source: str, target: str, quality: int) -> None:
    """Convert one file by an external program; raises ConversionFailed."""
    commands = {
        "sips": ["sips", "-s", "format", "heic", "-s", "formatOptions", str(quality), source, "--out", target],
        "heif-enc": ["heif-enc", "-q", str(quality), "-o", target, source],
    }
    done = subprocess.run(commands[name], capture_output=True, text=True, check=False)
    if done.returncode:
        raise ConversionFailed(f"{source}: {done.stderr}")


def convert_files(plan: DataFrame, encoder: Encoder, quality: int = 85) -> DataFrame:
    """`plan` (source, target, ...) with status copied (converted), skipped or failed."""
    return _run(plan, lambda s, t: _new_file(t, lambda temp: encoder(s, temp, quality)), files_each=50)
