"""Vendor (CSA) headers: named, multi-valued elements inside a private element."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of an element's head and of an item's head, and the limits that are read.
ELEMENT_HEAD, ITEM_HEAD = struct.Struct("<64sI4sIII"), struct.Struct("<II")
MOST_ELEMENTS, MOST_ITEMS = 2048, 512
HEADER_TAGS = {"csa_image_header": 0x1010, "csa_series_header": 0x1020}


def _text(raw: bytes) -> str:
    return raw.partition(b"\0")[0].decode("latin-1").strip()


def read_csa(raw: bytes) -> Iterator[tuple[str, str, int, list[str]]]:
    """name, vr, vm and values of each element, as far as the bytes go."""
    words = struct.unpack_from("<II", raw) if len(raw) >= 8 else (0, 0)
    if raw[:4] == b"SV10":
        count, at = struct.unpack_from("<I", raw, 8)[0] if len(raw) >= 12 else 0, 16
    else:
        count, at = words[0] if words[0] <= 10000 else words[1], 8
    for _ in range(min(count, MOST_ELEMENTS)):
        if at + ELEMENT_HEAD.size > len(raw):
            return
        name, vm, vr, _, items, _ = ELEMENT_HEAD.unpack_from(raw, at)
        at += ELEMENT_HEAD.size
        values = []
        for _ in range(min(items, MOST_ITEMS)):
            if at + ITEM_HEAD.size > len(raw):
                break
            length, _ = ITEM_HEAD.unpack_from(raw, at)
            at += ITEM_HEAD.size
            if at + length > len(raw):
                break
            values.append(_text(raw[at : at + length]))
            at += -(-length // 4) * 4
        if _text(name):
            yield _text(name), _text(vr), vm, [v for v in values if v]


def write_csa(elements: list[tuple[str, str, list[str]]], signed: bool = True) -> bytes:
    out = (b"SV10\4\3\2\1" if signed else b"") + struct.pack("<II", len(elements), 77)
    for name, vr, values in elements:
        out += ELEMENT_HEAD.pack(name.encode(), len(values), vr.encode(), 0, len(values), 77)
        for v in values:
            raw = v.encode("latin-1") + b"\0"
            out += ITEM_HEAD.pack(len(raw), 0) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")
    return out


def _by_name(raw: bytes | None) -> dict[str, list]:
    """vr, vm and values by name; a name given again replaces the earlier one."""
    return {name: rest for name, *rest in read_csa(bytes(raw or b""))}


def csa_elements(payloads: DataFrame) -> DataFrame:
    """file_path, name, vr, vm, pos, value from ``payloads`` (file_path, value_bytes); a name given again replaces the earlier one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["file_path"], batch["value_bytes"], strict=True):
                rows += [(path, name, vr or None, vm, i, v) for name, (vr, vm, values) in _by_name(raw).items() for i, v in enumerate(values or [None])]
            yield pd.DataFrame(rows, columns=["file_path", "name", "vr", "vm", "pos", "value"])

    return payloads.select("file_path", "value_bytes").mapInPandas(run, "file_path string, name string, vr string, vm long, pos int, value string")


def csa_json(elements: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """file_path and the elements as JSON text, values nested by name; with ``payloads`` the format and the number of elements stand beside them."""
    named = elements.groupBy("file_path", "name", "vr", "vm").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    held = named.groupBy("file_path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct("vr", "vm", "values"))))).alias("elements"))
    if payloads is None:
        return held.select("file_path", F.to_json("elements").alias("elements"))
    whole = F.struct("format", F.size("elements").alias("element_count"), "elements")
    return held.join(payloads.select("file_path", _kind().alias("format")), "file_path").select("file_path", F.to_json(whole).alias("elements"))


def _kind() -> Column:
    return F.when(F.substring("value_bytes", 1, 4) == F.lit(b"SV10"), "CSA2").otherwise("CSA1")


NESTED = pa.list_(pa.struct([("name", pa.string()), ("vr", pa.string()), ("vm", pa.int64()), ("values", pa.list_(pa.string()))]))


def csa_documents(payloads: DataFrame) -> DataFrame:
    """file_path, elements (JSON text with format and number, as ``csa_json`` of both gives it) and csa_hash of each payload that has elements.

    A payload's elements are nested where it is read, so nothing is shuffled, and
    payloads that share a path are told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"name": name, "vr": vr or None, "vm": vm, "values": values or [None]} for name, (vr, vm, values) in sorted(_by_name(raw.as_py()).items())] for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, NESTED)], names=["file_path", "value_bytes", "nested"])

    schema = "file_path string, value_bytes binary, nested array<struct<name:string,vr:string,vm:bigint,values:array<string>>>"
    read = payloads.select("file_path", "value_bytes").mapInArrow(run, schema).filter(F.size("nested") > 0)
    elements = F.map_from_entries(F.transform("nested", lambda x: F.struct(x["name"], F.struct(x["vr"].alias("vr"), x["vm"].alias("vm"), x["values"].alias("values")))))
    whole = F.struct(_kind().alias("format"), F.size("nested").alias("element_count"), elements.alias("elements"))
    return read.select("file_path", F.to_json(whole).alias("elements"), F.sha2("value_bytes", 256).alias("csa_hash"))


def csa_hash(payloads: DataFrame) -> DataFrame:
    return payloads.select("file_path", F.sha2("value_bytes", 256).alias("csa_hash"))
