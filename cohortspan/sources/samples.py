"""Transport files to read back: every task writes the rows it holds as one file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortspan.sources.xpt import NAMESTR_MARK, OBS_MARK, RECORD, resolve

_STAMP = b"01JAN18:00:00:00"


def double_to_ibm(values: np.ndarray) -> np.ndarray:
    """Doubles as 8-byte big-endian IBM hexadecimal floats; NaN as the missing code ``.``."""
    missing = np.isnan(values)
    fraction, binary = np.frexp(np.where(missing, 0.0, np.abs(values)))
    exponent = -(-binary // 4)
    mantissa = np.ldexp(fraction, binary - 4 * exponent + 56).astype(np.uint64)
    bits = ((exponent + 64).astype(np.uint64) << np.uint64(56)) | mantissa
    bits = np.where(mantissa == 0, np.uint64(0), bits) | (np.signbit(values).astype(np.uint64) << np.uint64(63))
    bits = np.where(missing, np.uint64(ord(".") << 56), bits)
    return bits.astype(">u8").view(np.uint8).reshape(-1, 8)


def encode(columns: list[str], data: pd.DataFrame, member: str = "DATA") -> bytes:
    """One transport file of numeric columns."""
    zeros = b"0" * 30 + b"  "
    library = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!" + zeros
    head = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!" + b"000000000000000001600000000140  "
    descriptor = b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!" + zeros
    name = member.encode().ljust(8)
    records = [
        library,
        b"SAS     SAS     SASLIB  9.4     X64     ".ljust(64) + _STAMP,
        _STAMP.ljust(RECORD),
        head,
        descriptor,
        b"SAS     " + name + b"SASDATA 9.4     X64     ".ljust(48) + _STAMP,
        _STAMP.ljust(RECORD),
        (NAMESTR_MARK + b"!!!!!!!" + b"000000" + f"{len(columns):04d}".encode() + b"0" * 20).ljust(RECORD),
    ]
    described = b"".join(
        struct.pack(">hhhh", 1, 0, 8, i + 1)
        + column.encode().ljust(8)
        + column.encode().ljust(40)
        + b" " * 8
        + struct.pack(">hhh", 0, 0, 0)
        + b"  "
        + b" " * 8
        + struct.pack(">hh", 0, 0)
        + struct.pack(">i", 8 * i)
        + b" " * 52
        for i, column in enumerate(columns)
    )
    described = described.ljust(-(-len(described) // RECORD) * RECORD)
    observations = (OBS_MARK + b"!!!!!!!" + zeros).ljust(RECORD)
    cells = [double_to_ibm(data[c].to_numpy(dtype=float, na_value=np.nan)) for c in columns]
    body = np.stack(cells, axis=1).tobytes() if len(data) else b""
    return b"".join(records) + described + observations + body.ljust(-(-len(body) // RECORD) * RECORD)


def write_xpt(df: DataFrame, folder: str, rows_per_file: int = 200_000) -> int:
    """Write numeric columns below ``folder``; returns the number of files.

    Names follow from the task and the position in it, so a repeated task writes the same files.
    """
    columns = df.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        filesystem, base = resolve(folder)
        filesystem.create_dir(base, recursive=True)
        number, held, count = 0, [], 0

        def flush() -> None:
            with filesystem.open_output_stream(f"{base}/part-{task:05d}-{number:05d}.xpt") as out:
                out.write(encode(columns, pd.concat(held)))

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= rows_per_file:
                flush()
                number, held, count = number + 1, [], 0
        if count:
            flush()
            number += 1
        yield pd.DataFrame({"files": [number]})

    return df.mapInPandas(write, "files INT").agg({"files": "sum"}).first()[0] or 0
