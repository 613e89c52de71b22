"""The image file table and the private tag table that queries read, mapped from the given tables.

The same text runs in Spark and in DuckDB. The grain of ``files`` is a line item:
study = order, patient = customer, device = supplier, tracer and vendor hash =
part; ``tags`` has six private tags for each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("lineitem", "orders", "customer", "part", "supplier")

FILES_SQL = """
SELECT
  concat('scan', cast(l_orderkey % 7 as string), '/', lpad(cast(l_orderkey as string), 8, '0'), '_', cast(l_linenumber as string), '_', lpad(cast(l_partkey as string), 6, '0'), '_', lpad(cast(l_suppkey as string), 5, '0'), '.dcm') AS file_path,
  concat('P', lpad(cast(c_custkey as string), 6, '0')) AS patient_id,
  CASE WHEN c_custkey % 5 = 0 THEN concat('Anonymous^', lpad(cast(c_custkey as string), 5, '0'), '^^^') WHEN c_custkey % 31 = 0 THEN NULL ELSE concat(c_mktsegment, '^', c_name) END AS patient_name,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat(cast(1930 + c_custkey % 80 as string), '0615') END AS patient_birth_date,
  CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE NULL END AS patient_sex,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat(lpad(cast(c_custkey % 95 as string), 3, '0'), 'Y') END AS patient_age,
  cast(CASE WHEN c_custkey % 13 = 0 OR l_linenumber = 7 THEN NULL WHEN c_custkey % 29 = 0 THEN 0 ELSE 40 + c_custkey % 80 END as double) AS patient_weight,
  cast(CASE WHEN c_custkey % 26 = 0 THEN 72 WHEN c_custkey % 7 = 0 THEN NULL ELSE (150 + c_custkey % 50) / 100.0 END as double) AS patient_size,
  concat('1.2.840.', cast(l_orderkey as string)) AS study_instance_uid,
  concat(cast(year(o_orderdate) as string), lpad(cast(month(o_orderdate) as string), 2, '0'), lpad(cast(day(o_orderdate) as string), 2, '0')) AS study_date,
  concat(lpad(cast(7 + l_orderkey % 10 as string), 2, '0'), lpad(cast(l_orderkey % 60 as string), 2, '0'), '00') AS study_time,
  concat('Study ', o_orderpriority) AS study_description,
  cast(o_custkey as string) AS study_id,
  concat('ACC', cast(l_orderkey as string)) AS accession_number,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE concat('1.2.840.', cast(l_orderkey as string), '.', cast(l_linenumber as string)) END AS series_instance_uid,
  concat('1.2.840.', cast(l_orderkey as string), '.', cast(l_linenumber as string), '.', cast(l_partkey % 50 as string)) AS sop_instance_uid,
  cast(l_linenumber as int) AS series_number,
  CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE concat(lpad(cast(7 + l_orderkey % 10 + l_linenumber % 4 as string), 2, '0'), lpad(cast(l_suppkey % 60 as string), 2, '0'), '00') END AS series_time,
  p_name AS series_description,
  CASE (l_suppkey + l_linenumber) % 12 WHEN 0 THEN 'PT' WHEN 1 THEN 'PT' WHEN 2 THEN 'PT' WHEN 3 THEN 'PT' WHEN 4 THEN 'CT' WHEN 5 THEN 'CT' WHEN 6 THEN 'NM' WHEN 7 THEN 'SEG' WHEN 8 THEN 'RTSTRUCT' WHEN 9 THEN 'MR' WHEN 10 THEN 'pt' ELSE NULL END AS modality,
  CASE s_nationkey % 6 WHEN 0 THEN 'SIEMENS' WHEN 1 THEN 'GE MEDICAL SYSTEMS' WHEN 2 THEN 'Philips' WHEN 3 THEN 'QIICR' WHEN 4 THEN 'highdicom' ELSE NULL END AS manufacturer,
  concat('Model-', cast(s_nationkey % 3 as string)) AS manufacturer_model_name,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('VB', cast(l_partkey % 3 as string)) END AS software_version,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE concat(cast(year(o_orderdate) as string), lpad(cast(month(o_orderdate) as string), 2, '0'), lpad(cast(day(o_orderdate) as string), 2, '0')) END AS acquisition_date,
  CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE concat(lpad(cast(8 + l_orderkey % 10 + l_partkey % 6 as string), 2, '0'), lpad(cast(l_suppkey % 60 as string), 2, '0'), '30.250') END AS acquisition_time,
  CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE concat(cast(year(o_orderdate) as string), lpad(cast(month(o_orderdate) as string), 2, '0'), lpad(cast(day(o_orderdate) as string), 2, '0')) END AS injection_date,
  CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 101 = 0 THEN 'bad' WHEN l_partkey % 23 = 0 THEN '235900' ELSE concat(lpad(cast(7 + l_orderkey % 10 as string), 2, '0'), lpad(cast(l_partkey % 60 as string), 2, '0'), '00') END AS injection_time,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE p_type END AS radiopharmaceutical,
  cast(CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 53 = 0 THEN 9000 WHEN l_partkey % 3 = 0 THEN (100 + l_partkey % 300) * 1000000 ELSE 100 + l_partkey % 300 END as double) AS injected_activity,
  cast(CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 6586 END as double) AS half_life,
  cast(CASE WHEN (l_suppkey + l_linenumber) % 12 IN (4, 5) THEN l_discount * 100 END as double) AS ctdivol,
  cast(CASE WHEN (l_suppkey + l_linenumber) % 12 IN (4, 5) THEN l_quantity * 10 END as double) AS dlp,
  cast(l_quantity as int) AS number_of_slices,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE p_brand END AS csa_series_header_hash
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""

TAGS_SQL = """
SELECT f.sop_instance_uid, f.series_instance_uid, f.study_instance_uid, f.file_path, f.manufacturer, f.modality,
  t.group_hex, t.element_hex, t.creator, t.vr,
  CASE t.kind WHEN 'label' THEN concat('COLL-', cast(f.number_of_slices % 15 as string))
              WHEN 'ts' THEN concat(f.study_date, '101500.5')
              WHEN 'num' THEN cast(f.number_of_slices as string)
              WHEN 'xml' THEN concat('<r><PetDoseReportData/><m_StatisticsNameVector>Dose</m_StatisticsNameVector><m_StatisticsValueVector1>', cast(f.number_of_slices as string), '</m_StatisticsValueVector1></r>')
              ELSE NULL END AS value_text,
  CASE WHEN t.kind = 'bin' THEN '00ff10' END AS value_hex
FROM files f CROSS JOIN (VALUES
  ('0013', '1010', 'CTP', 'LO', 'label'), ('0013', '1015', 'CTP', 'US', 'num'),
  ('0029', '1031', 'SIEMENS CSA HEADER', 'OB', 'xml'), ('0009', '1010', 'GEMS_IDEN_01', 'DT', 'ts'),
  ('3287', '1000', 'Varian Medical Systems VISION 3287', 'LO', 'ts'), ('0099', '1001', 'Unknown', 'UN', 'bin')
) AS t(group_hex, element_hex, creator, vr, kind)
"""


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input comes in fewer splits than that; a table of many splits is read as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of supplier keys, two numbers each, that are broadcast when they were counted.
BROADCAST_SUPPLIERS = 500_000
#: Rows of files that a task sorts by study; more of them in one would not fit in its memory, with all their columns.
TASK_ROWS = 250_000
UID_SQL = "concat('1.2.840.', cast({key} as string))"


#: Order keys behind the first number, if any, up to the second, if any.
Studies = tuple[int | None, int | None]


def study_ranges(spark: SparkSession, sf_dir: str, rows: int, whole: int = 1) -> list[Studies]:
    """Ranges of studies that cover all of them, of about so many files each; ``whole`` studies in a row are never parted."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey")
    n = -(-lines.count() // rows)
    if n < 2:
        return [(None, None)]
    (cuts,) = lines.agg(F.percentile_approx("l_orderkey", [i / n for i in range(1, n)], 100 * n)).first()
    ends = sorted({k // whole * whole - 1 for k in cuts})
    return list(zip([None, *ends], [*ends, None], strict=True))


def _among(rows: DataFrame, key: str, studies: Studies) -> DataFrame:
    after, last = studies
    rows = rows if after is None else rows.filter(F.col(key) > after)
    return rows if last is None else rows.filter(F.col(key) <= last)


def files(spark: SparkSession, sf_dir: str, studies: Studies = (None, None)) -> DataFrame:
    """The rows of FILES_SQL, or those of some ``studies``. The small tables are joined first, and line items meet their orders by the study's UID, so
    that what follows by study, or by study and series, is not dealt anew."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in GIVEN}
    tables |= {name: _among(tables[name], key, studies) for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    study = lambda key: F.expr(UID_SQL.format(key=key)).alias("study_instance_uid")
    lines = _dealt(tables["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"))
    devices = tables["supplier"].select("s_suppkey", "s_nationkey")
    if devices.count() <= BROADCAST_SUPPLIERS:
        devices = F.broadcast(devices)
    parts = tables["part"].select("p_partkey", "p_name", "p_type", "p_brand")
    people = tables["customer"].select("c_custkey", "c_mktsegment", "c_name")
    orders = tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    ordered = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select("*", study("o_orderkey"))
    made = lines.join(devices, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("*", study("l_orderkey"))
    tasks = -(-tables["lineitem"].count() // TASK_ROWS)
    if tasks > spark.sparkContext.defaultParallelism:
        # a number is given, else few bytes of keys would bring many rows, which become wide behind the join, to one task
        made, ordered = made.repartition(tasks, "study_instance_uid"), ordered.repartition(tasks, "study_instance_uid")
    columns = FILES_SQL[: FILES_SQL.index("\nFROM lineitem ")].replace(f"{UID_SQL.format(key='l_orderkey')} AS study_instance_uid", "study_instance_uid")
    return spark.sql(f"{columns}\nFROM {{rows}}", rows=made.join(ordered, "study_instance_uid"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags_of(spark, files(spark, sf_dir))


def tags_of(spark: SparkSession, given: DataFrame) -> DataFrame:
    return spark.sql(TAGS_SQL.replace("FROM files f", "FROM {files} f"), files=given)
