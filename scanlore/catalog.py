"""All queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
import struct
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import bitmaps, dashboard, detail, export, filters, places, private_tags, representative, store, studies
from .plans import inputs, oracle
from .sources import archives, databank, headers, ranges, vendor
from .sources import header_batches as many
from .scratch import in_rounds, scratch_path, shuffles_let_go
from .streaming import ingest

UID = "study_instance_uid"


#: The files of a series are of one study.
WITHIN = (UID,)


def series(spark: SparkSession, d: str) -> DataFrame:
    return store.dedup_series(inputs.files(spark, d), WITHIN)


def rep(spark: SparkSession, d: str) -> DataFrame:
    return representative.enriched(series(spark, d), WITHIN, unique=True)


def _rounded(df: DataFrame, places: int = 6, **more: int) -> DataFrame:
    return df.withColumns({c: F.round(c, more.get(c, places)) for c, t in df.dtypes if t == "double"})


def _of_series(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(series(spark, d))


def _of_rep(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(rep(spark, d))


def _of_both(f: Callable[[DataFrame, DataFrame], DataFrame]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = series(spark, d)
        return f(representative.enriched(own, WITHIN, unique=True), own)

    return run


def _of_tags(f: Callable[[DataFrame, DataFrame], DataFrame]):
    return lambda spark, d: f(inputs.tags(spark, d), rep(spark, d))


def _existing(files: DataFrame) -> DataFrame:
    """What counts as stored before: studies with an even order key."""
    return files.filter(F.element_at(F.split(UID, r"\."), 4).cast("long") % 2 == 0)


def _of_existing(f: Callable[[DataFrame, DataFrame], DataFrame]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        files = inputs.files(spark, d)
        return f(files, _existing(files))

    return run


def dedup_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = inputs.tags_of(spark, store.files_of_kept_paths(inputs.files(spark, d), WITHIN)).withColumn("value_hash", F.sha2(F.coalesce("value_text", "value_hex").cast("binary"), 256))
    kind = private_tags.tag_classify(F.col("creator"), F.col("manufacturer"), F.col("value_text"), F.lit(None).cast("double"))
    kept = store.dedup_tags(tags.select(UID, "file_path", *store.TAG_KEY, kind.alias("classification")), WITHIN)
    return kept.select("series_instance_uid", "group_hex", "element_hex", "creator", "classification")


def prune_report(spark: SparkSession, d: str) -> DataFrame:
    own = series(spark, d)
    return store.prune_report(own, representative.representative_ingest(own))


def prune_tags(spark: SparkSession, d: str) -> DataFrame:
    kept = store.prune_tags(inputs.tags(spark, d), representative.representative_ingest(series(spark, d)))
    return kept.select("series_instance_uid", "group_hex", "element_hex")


def _filter_index(spark: SparkSession, d: str) -> bitmaps.FilterIndex:
    own = series(spark, d)
    return bitmaps.FilterIndex.build(representative.representative_query(own, WITHIN, unique=True), own)


def filter_combine(spark: SparkSession, d: str) -> DataFrame:
    """Four filters in one pass over the tables, combined as bitmaps."""
    return _filter_index(spark, d).select(uptake=("10", None), timing="ok", qa_score="4", composition="missing_ct")


def filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many studies every value of every filter has."""
    return _filter_index(spark, d).counts()


EXPORTED = ["patient_id", "patient_sex", "study_date", "series_number", "modality", "uptake_delay", "dose_per_kg", "bmi"]


#: Columns of a file that its header is made of.
HEADED = ["file_path", "patient_id", "patient_weight", UID, "study_date", "series_instance_uid", "series_number", "modality", "manufacturer", "acquisition_time", "injection_time", "radiopharmaceutical", "injected_activity", "half_life", "ctdivol", "number_of_slices"]


def _contents(batch: pa.RecordBatch, implicit: bool = True) -> pa.Array:
    """A header for each file row, every other one implicit, with a private block and a tracer sequence."""
    kinds = {c: headers.KINDS[headers.TAGS[c]].decode() for c in HEADED if c in headers.TAGS}
    slices = pc.fill_null(batch.column("number_of_slices"), 0).to_numpy(zero_copy_only=False)
    packed = {"ctdivol": "<f8", "slices": "<u2"}
    raw = {c: pa.Array.from_buffers(pa.binary(np.dtype(k).itemsize), len(slices), [None, pa.py_buffer(np.ascontiguousarray(v, k))]).cast(pa.binary()) for (c, k), v in zip(packed.items(), (pc.fill_null(batch.column("ctdivol"), 0.0), slices), strict=True)}
    made = {c: many.bodies(batch.column(c)) for c in HEADED[1:] if c != "ctdivol"}
    made["ctdivol"] = pc.if_else(pc.is_valid(batch.column("ctdivol")), raw["ctdivol"], pa.scalar(None, pa.binary()))
    inner = ("injection_time", "radiopharmaceutical", "half_life")
    item = sorted([*((headers.TAGS[c], kinds[c], made[c]) for c in inner), (headers.TAGS["radionuclide_total_dose"], "DS", made["injected_activity"])], key=lambda e: e[0])
    elements = [(headers.TAGS[c], kinds[c], made[c]) for c in HEADED[1:] if c in kinds and c not in inner]
    elements += [(0x00540016, "SQ", item), (headers.TAGS["images_in_acquisition"], "IS", pc.fill_null(made["number_of_slices"], b""))]
    label = pa.array([f"COLL-{i}".encode() for i in range(15)], pa.binary()).take(pa.array(slices % 15))
    creator = pa.array([b"CTP"], pa.binary()).take(pa.array(np.zeros(len(slices), np.int8)))
    elements += [(0x00130010, "LO", creator), (0x00131010, "LO", label), (0x00131013, "LO", pc.fill_null(made["patient_id"], b"")), (0x00131015, "UN", raw["slices"])]
    odd = pc.fill_null(batch.column("series_number"), 0).to_numpy(zero_copy_only=False) % 2 == 1
    return many.write_headers(elements, odd if implicit else np.ones(len(slices), bool))


def _header_bytes(files: DataFrame, implicit: bool = True) -> DataFrame:
    """path and content of a header for each file row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), _contents(batch, implicit)], names=["path", "content"])

    return files.select(*HEADED).mapInArrow(run, "path string, content binary")


def header_files(spark: SparkSession, d: str, implicit: bool = True) -> DataFrame:
    """path and content of the files that ``inputs.files`` describes, made where they are read."""
    return _header_bytes(inputs.files(spark, d), implicit)


#: Bytes of archives that leave a task together.
PACKED_BYTES = 4 << 20


def archive_files(spark: SparkSession, d: str) -> DataFrame:
    """path and content of a ZIP for each study, made where they are read: a study's rows follow one another, and many studies are packed in a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, bytes]] = []
        study, out, archive, size = None, None, None, 0

        def end() -> int:
            if archive is None:
                return 0
            archive.close()
            made.append((f"{study}.zip", out.getvalue()))
            return len(made[-1][1])

        for batch in batches:
            for name, own, content in zip(batch.column("file_path").to_pylist(), batch.column(UID).to_pylist(), _contents(batch).to_pylist(), strict=True):
                if archive is None or own != study:
                    size += end()
                    if size > PACKED_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "content"])
                        made, size = [], 0
                    study, out = own, BytesIO()
                    archive = zipfile.ZipFile(out, "w")
                archive.writestr(zipfile.ZipInfo(name.replace("/", "_")), content)
                archive.writestr(zipfile.ZipInfo(f"__MACOSX/._{name}"), b"junk")
        end()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "content"])

    # the window lets a study's rows lie together, without a shuffle where they do already
    placed = inputs.files(spark, d).select(*HEADED, F.row_number().over(Window.partitionBy(UID).orderBy("file_path")).alias("place"))
    return placed.sortWithinPartitions(UID, "place").select(*HEADED, "place").mapInArrow(pack, "path string, content binary")


HEADER_COLUMNS = ["patient_id", "patient_weight", UID, "study_date", "series_instance_uid", "series_number", "modality", "manufacturer", "acquisition_time", "injection_time", "radiopharmaceutical", "injected_activity", "half_life", "ctdivol", "number_of_slices"]


def parse_headers(spark: SparkSession, d: str) -> DataFrame:
    return headers.parse_wide(header_files(spark, d), columns=HEADER_COLUMNS).filter("error IS NULL").drop("error")


def _loose_files(spark: SparkSession, d: str, some: inputs.Studies = (None, None)) -> str:
    """A folder with every header as a file of its own, followed by pixels; those of CUT_SLICES slices lack their last byte.

    Headers are made where they are written; of rows that repeat a path the one with the fewest slices is.
    """
    root = scratch_path(spark, "loose-headers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = ranges.file_system(root)
        made: set[str] = set()
        for batch in batches:
            for path, content, slices in zip(batch.column("file_path").to_pylist(), _contents(batch).to_pylist(), batch.column("number_of_slices").to_pylist(), strict=True):
                folder = f"{inner}/{path.rpartition('/')[0]}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{inner}/{path}") as out:
                    out.write(content[:-1] if slices == CUT_SLICES else content + PIXEL_HEAD + bytes(256))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    # the rows of a path are of one study, by which they lie
    order = Window.partitionBy(UID, "file_path").orderBy("number_of_slices")
    # a number is given, else few bytes of rows would bring many files to one task
    dealt = inputs.files(spark, d, some).select(*HEADED).repartition(4 * spark.sparkContext.defaultParallelism, UID)
    files = dealt.select(*HEADED, F.row_number().over(order).alias("__rn")).filter("__rn = 1")
    files.select(*HEADED).mapInArrow(write, "n long").agg(F.sum("n")).first()
    return root


CUT_SLICES = 11
PIXEL_HEAD = struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, 256)


#: Files that lie on the disk at once; each takes a block of it at least.
LOOSE_FILES = 500_000


def _rounds(spark: SparkSession, d: str, name: str, rows: int, run: Callable[[inputs.Studies], DataFrame], whole: int = 1) -> DataFrame:
    """``run`` over all studies, so many files of them at a time; where that is all, it is not written."""
    found = inputs.study_ranges(spark, d, rows, whole)
    return run(found[0]) if len(found) == 1 else in_rounds(spark, name, [functools.partial(run, x) for x in found])


def scan_headers(spark: SparkSession, d: str) -> DataFrame:
    """The data source over real files: readable ones with some columns, others with what is wrong. Files are written, read and deleted by studies."""

    def run(some: inputs.Studies) -> DataFrame:
        root = _loose_files(spark, d, some)
        found = headers.scan_headers(spark, root, columns=["series_instance_uid", "modality", "injected_activity", "number_of_slices"])
        return found.withColumn("file_path", headers.relative_path(F.col("file_path"), ranges.file_system(root)[1]))

    return _rounds(spark, d, "scanned", LOOSE_FILES, run)


def ctp_columns(spark: SparkSession, d: str) -> DataFrame:
    found = private_tags.ctp_columns(headers.parse_headers(header_files(spark, d, implicit=False), private=True))
    return found.select("file_path", "ctp_collection", "ctp_subject_id", F.col("ctp_private_flag_int").cast("int").alias("ctp_private_flag_int"))


def _tag_rows(spark: SparkSession, d: str) -> DataFrame:
    files = inputs.files(spark, d)
    return private_tags.tag_rows(headers.parse_headers(header_files(spark, d, implicit=False), private=True), files)


def private_decode(spark: SparkSession, d: str) -> DataFrame:
    return _tag_rows(spark, d).select("file_path", "group_hex", "element_hex", "creator", "value_text", "value_num", "value_hex", "value_hash", "classification")


def payload_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return private_tags.payload_fingerprint(_tag_rows(spark, d))


def creator_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose creator is named again inside a sequence: by an empty text, by another name, or not at all."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for n in batch["number_of_slices"]:
                again = [[(0x00190010, "LO", "NEST" if n % 3 else " ")]] if n % 3 < 2 else []
                made.append(headers.write_header([(0x00190010, "LO", "ACME"), (0x00191001, "LO", "x"), (0x00191101, "LO", "y"), (0x00540016, "SQ", again)], n % 2 == 0))
            yield pd.DataFrame({"path": batch["file_path"], "content": made})

    files = inputs.files(spark, d).select("file_path", "number_of_slices")
    found = private_tags.creator_resolve(headers.parse_headers(files.mapInPandas(write, "path string, content binary"), private=True))
    return found.select("file_path", F.hex("element").alias("element_hex"), "creator")


def _vendor_headers(spark: SparkSession, d: str) -> DataFrame:
    """file_path and value_bytes of a vendor header for every file with a vendor hash."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["file_path"], batch["csa_series_header_hash"], batch["number_of_slices"], batch["modality"], strict=True)
            yield pd.DataFrame([(p, vendor.write_csa([("CsaSeriesHash", "LO", [h]), ("Slices", "IS", [str(n), m or ""])], n % 2 == 0)) for p, h, n, m in rows], columns=["file_path", "value_bytes"])

    known = inputs.files(spark, d).filter("csa_series_header_hash IS NOT NULL").select("file_path", "csa_series_header_hash", "number_of_slices", "modality")
    return known.mapInPandas(pack, "file_path string, value_bytes binary")


def csa_elements(spark: SparkSession, d: str) -> DataFrame:
    return vendor.csa_elements(_vendor_headers(spark, d))


def csa_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON form, and whether its hash is that of the bytes it was read from."""
    return vendor.csa_documents(_vendor_headers(spark, d)).select("file_path", "elements", F.length("csa_hash").alias("hash_length"))


def expand_archive(spark: SparkSession, d: str) -> DataFrame:
    """A ZIP for each study, taken apart and read."""
    found = archives.expand_archive(archive_files(spark, d))
    named = found.withColumn("name", F.concat_ws("/", "archive", "member"))
    wide = headers.parse_wide(named, "name", columns=["series_number"]).filter("error IS NULL")
    return wide.select(F.split("file_path", "/")[0].alias("archive"), F.split("file_path", "/")[1].alias("member"), "series_number")


#: Studies whose headers share an archive, and what goes wrong with members of so many slices.
ARCHIVE_STUDIES = 4096
DAMAGED = {13: "damaged", 17: "encrypted"}


def _archives_on_disk(spark: SparkSession, d: str, some: inputs.Studies = (None, None)) -> str:
    """A folder of ZIP files, each of the headers of many studies, deflated; some members are encrypted or damaged.

    Headers are made where they are packed, so only the rows of files are shuffled.
    """
    root = scratch_path(spark, "archives")

    def write(own: pa.Table) -> pa.Table:
        system, inner = ranges.file_system(root)
        system.create_dir(inner, recursive=True)
        rows = own.combine_chunks().to_batches()[0]
        out, spoilt = BytesIO(), []
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content, slices in zip(rows.column("file_path").to_pylist(), _contents(rows).to_pylist(), rows.column("number_of_slices").to_pylist(), strict=True):
                archive.writestr(name, content)
                if slices in DAMAGED:
                    spoilt.append((archive.infolist()[-1], DAMAGED[slices]))
                    if DAMAGED[slices] == "encrypted":
                        archive.infolist()[-1].flag_bits |= archives.ENCRYPTED
        data = bytearray(out.getvalue())
        for x, how in spoilt:
            if how == "damaged":
                start = x.header_offset + archives.LOCAL_HEAD.size + len(x.filename)
                data[start : start + x.compress_size] = b"\xff" * x.compress_size
        with system.open_output_stream(f"{inner}/{rows.column("part")[0].as_py()}.zip") as file:
            file.write(bytes(data))
        return pa.table({"n": [len(own)]})

    part = F.floor(F.element_at(F.split(UID, r"\."), 4).cast("long") / ARCHIVE_STUDIES)
    inputs.files(spark, d, some).select(*HEADED, part.alias("part")).groupBy("part").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return root


#: Files whose archives lie on the disk at once.
ARCHIVED_FILES = 4_000_000


def scan_archives(spark: SparkSession, d: str) -> DataFrame:
    """Headers out of archives on disk: the directory by a range, each member by its own; members that cannot be read with what is wrong.

    Archives are written, read and deleted by studies."""

    def run(some: inputs.Studies) -> DataFrame:
        members = archives.archive_members(spark, _archives_on_disk(spark, d, some))
        found = archives.member_headers(members, ["series_instance_uid", "series_number"])
        wrong = F.when(F.startswith("error", F.lit("broken deflate data")), "damaged").otherwise(F.col("error"))
        return found.select(F.regexp_extract("archive", r"([^/]+)$", 1).alias("archive"), "member", "series_instance_uid", "series_number", wrong.alias("error"))

    return _rounds(spark, d, "archived", ARCHIVED_FILES, run, ARCHIVE_STUDIES)


#: Files that come to the databank at once.
BANKED_FILES = 4_000_000


def databank_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Two ingests into a laid out databank, a study deleted, the rest pruned; the second ingest brings the first one's files again. Files come by studies."""
    root = scratch_path(spark, "bank")
    bank = databank.Bank(spark, root, "bank_" + root[-32:], lots=8, buckets=8, within=WITHIN)
    some = inputs.study_ranges(spark, d, BANKED_FILES)
    for part in (_existing, lambda files: files):
        for x in some:
            bank.append(part(inputs.files(spark, d, x)), lambda new: inputs.tags_of(spark, new))
    bank.delete_study("1.2.840.1")
    stored = bank.read(databank.SERIES)
    bank.prune(representative.representative_ingest(stored.drop(databank.KEY, databank.LOT)))
    tags = bank.read(databank.TAGS).groupBy("file_path").agg(F.count("*").alias("n_tags"))
    return bank.read(databank.SERIES).join(tags, "file_path", "left").select("file_path", "series_instance_uid", "representative_flag", "n_tags")


def series_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The series with the smallest UID."""
    own = series(spark, d)
    (uid,) = own.agg(F.min("series_instance_uid")).first()
    return detail.series_lookup(own, uid).select("file_path", "series_instance_uid", "modality")


PARTS = 4


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The header files come in parts cut across the series, so that a series' files are in several of them.

    The first part is a stored table, which enters the state of the stream with
    the first batch; each other is read by its own run of the stream, the second a second
    time at the end. Equal to the batch dedup, as the parts' borders are by the
    last number in a path but one, which follows the series in it.
    """
    root = scratch_path(spark, "stream")
    files = inputs.files(spark, d)
    lot = F.substring("file_path", 18, 6).cast("int")
    most = files.agg(F.max(lot)).first()[0] or 0
    part = F.floor(lot * PARTS / (most + 1)).cast("int")
    found = [_header_bytes(files.filter(part == i)) for i in range(PARTS)]
    with shuffles_let_go(spark):
        ingest.append_new(found[0], f"{root}/stored")
        stored = spark.read.parquet(f"{root}/stored")
        for i in (*range(1, PARTS), 1):
            found[i].write.mode("append").parquet(f"{root}/in")
            ingest.ingest_stream(spark.readStream.schema(found[i].schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/log", spark.readStream.schema(stored.schema).parquet(f"{root}/stored")).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("file_path", "series_instance_uid").unionByName(stored.select("file_path", "series_instance_uid"))


def ctp_demographics(spark: SparkSession, d: str) -> DataFrame:
    """Demographics over series that carry the trial's columns."""
    trial = private_tags.ctp_columns(headers.parse_headers(header_files(spark, d, implicit=False), private=True))
    return dashboard.demographics(series(spark, d).join(trial, "file_path", "left"))


#: Files whose series are dumped at once.
DUMPED_FILES = 4_000_000


def json_dump(spark: SparkSession, d: str) -> DataFrame:
    """Series with their tags nested, written as JSON and read again, by studies."""

    def run(some: inputs.Studies) -> DataFrame:
        path, files = scratch_path(spark, "json"), inputs.files(spark, d, some)
        tags = inputs.tags_of(spark, store.files_of_kept_paths(files, WITHIN))
        with shuffles_let_go(spark):
            export.json_dump(store.dedup_series(files, WITHIN), tags.select(*WITHIN, "file_path", "group_hex", "element_hex", "creator", "value_text"), path, WITHIN)
        kinds = "file_path string, series_instance_uid string, modality string, private_tags array<struct<group_hex:string,element_hex:string,creator:string,value_text:string>>"
        return spark.read.schema(kinds).json(path).select("file_path", "series_instance_uid", "modality", F.greatest(F.coalesce(F.size("private_tags"), F.lit(0)), F.lit(0)).cast("long").alias("n_tags"))

    return _rounds(spark, d, "dumped", DUMPED_FILES, run)


def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """Studies in the order of the list, with their place in it."""
    listed = studies.study_list(series(spark, d)).select(UID, "study_date", "study_time")
    return places.placed(listed, studies.newest_order()).select(UID, "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dedup_series": lambda s, d: series(s, d).select("file_path", "series_instance_uid", UID, "modality"),
    "dedup_tags": dedup_tags,
    "representative_ingest": lambda s, d: _rounded(representative.representative_ingest(series(s, d)).select(UID, "series_instance_uid", "score", "delay_minutes", "dose_per_kg")),
    "representative_query": lambda s, d: _rounded(representative.representative_query(series(s, d)).select(UID, "series_instance_uid", "score", "delay_minutes", "dose_per_kg")),
    "prune_report": prune_report,
    "prune_tags": prune_tags,
    "delete_study": lambda s, d: store.delete_study(series(s, d), inputs.tags(s, d), "1.2.840.1")[0].select("file_path", "series_instance_uid"),
    "new_studies": _of_existing(store.new_studies),
    "skip_existing_paths": _of_existing(lambda f, e: store.skip_existing_paths(f, e).select("file_path")),
    "ingest_report": _of_existing(store.ingest_report),
    "newest_first": newest_first,
    "missing_issues": _of_both(filters.missing_issues),
    "timing_issues": _of_rep(filters.timing_issues),
    "dose_issues": _of_rep(filters.dose_issues),
    "composition_issues": _of_series(filters.composition_issues),
    "ctp_demographics": ctp_demographics,
    "series_lookup": series_lookup,
    "study_export_info": _of_series(export.study_export_info),
    "json_dump": json_dump,
    "study_list": _of_series(lambda x: studies.with_text_lists(studies.study_list(x))),
    "facet_values": _of_series(studies.facet_values),
    "facet_filter": _of_series(lambda x: studies.facet_filter(studies.study_list(x), modality=["PT", "CT"], manufacturer=["SIEMENS"]).select(UID)),
    "text_search": _of_series(lambda x: studies.with_text_lists(studies.text_search(x, " Economy "))),
    "match_score": _of_series(lambda x: studies.match_score(studies.with_text_lists(studies.text_search(x, "economy")), "economy").select(UID, "match_score", "match_field")),
    "match_score_exact": _of_series(lambda x: studies.match_score(studies.with_text_lists(studies.text_search(x, "economy")), "economy").filter("match_score >= 0.9").select(UID, "match_score")),
    "range_filter": _of_rep(lambda r: filters.range_filter(r, ("30", "90.5"), ("0.5", "5"))),
    "missing_filter": _of_both(lambda r, x: filters.missing_filter(r, x, "dose")),
    "timing_filter": _of_rep(lambda r: filters.timing_filter(r, "negative")),
    "dose_issue_filter": _of_rep(lambda r: filters.dose_issue_filter(r, "outlier")),
    "qa_score_filter": _of_rep(lambda r: filters.qa_score_filter(r, 4)),
    "composition_filter": _of_series(lambda x: filters.composition_filter(x, "missing_ct")),
    "filter_combine": filter_combine,
    "filter_counts": filter_counts,
    "export_modality_filter": _of_series(lambda x: filters.export_modality_filter(x, ["PT", "CT"]).select("file_path", "modality")),
    "uptake_stats": _of_rep(dashboard.uptake_stats),
    "dose_stats": _of_rep(dashboard.dose_stats),
    "scan_duration": _of_rep(dashboard.scan_duration),
    "modality_summary": _of_rep(dashboard.modality_summary),
    "radiopharm_summary": _of_rep(dashboard.radiopharm_summary),
    "ct_dose_summary": _of_rep(dashboard.ct_dose_summary),
    "tracer_top10": _of_rep(dashboard.tracer_top10),
    "manufacturer_top10": _of_rep(dashboard.manufacturer_top10),
    "study_dates": _of_series(dashboard.study_dates),
    "study_hours": _of_series(dashboard.study_hours),
    "demographics": _of_series(dashboard.demographics),
    "missingness": _of_both(dashboard.missingness),
    "repeat_rate": _of_series(dashboard.repeat_rate),
    "dashboard_totals": _of_series(dashboard.dashboard_totals),
    "series_per_study": _of_series(representative.series_per_study),
    "completeness": _of_both(dashboard.completeness),
    "timing_integrity": _of_rep(dashboard.timing_integrity),
    "dose_plausibility": _of_rep(dashboard.dose_plausibility),
    "qa_score_distribution": _of_rep(dashboard.qa_score_distribution),
    "study_composition": _of_series(dashboard.study_composition),
    "scanner_landscape": _of_rep(dashboard.scanner_landscape),
    "protocol_radiopharm": _of_rep(dashboard.protocol_radiopharm),
    "derived_objects": _of_rep(dashboard.derived_objects),
    "duplicate_check": _of_series(dashboard.duplicate_check),
    "uptake_histogram": _of_rep(dashboard.uptake_histogram),
    "dose_histogram": _of_rep(dashboard.dose_histogram),
    "ctp_labels": _of_tags(private_tags.ctp_labels),
    "private_creator_counts": _of_tags(private_tags.private_creator_counts),
    "pipeline_provenance": _of_tags(lambda t, r: private_tags.provenance(t, r, "pipeline_provenance")),
    "rt_provenance": _of_tags(lambda t, r: private_tags.provenance(t, r, "rt_provenance")),
    "pet_dose_reports": _of_tags(private_tags.pet_dose_reports),
    "study_summary": _of_series(lambda x: dashboard.study_summary(x).drop("patient_id", "patient_name")),
    "study_detail": _of_series(lambda x: _rounded(detail.study_detail(x), activity_at_scan=3)),
    "export_numeric": _of_series(lambda x: _rounded(export.export_numeric(x, EXPORTED))),
    "export_grouped": _of_series(lambda x: export.blank_repeats(export.export_text(x, ["patient_id", "patient_sex", "series_number", "modality"]))),
    "export_sectioned": _of_series(lambda x: export.sectioned(export.export_text(x, ["patient_id", "series_number", "modality"]))),
    "export_text": _of_series(lambda x: export.export_text(x, [*export.DEFAULTS, "uptake_delay", "dose_per_kg", "bmi", "half_life"])),
    "parse_headers": parse_headers,
    "scan_headers": scan_headers,
    "databank_upkeep": databank_upkeep,
    "ctp_columns": ctp_columns,
    "private_decode": private_decode,
    "payload_fingerprint": payload_fingerprint,
    "creator_resolve": creator_resolve,
    "csa_elements": csa_elements,
    "csa_json": csa_json,
    "expand_archive": expand_archive,
    "scan_archives": scan_archives,
    "stream_ingest": stream_ingest,
}

ORACLE: dict[str, str] = {name: text for name, text in oracle.ORACLE.items() if name in QUERIES}
