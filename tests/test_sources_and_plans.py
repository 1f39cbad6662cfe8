import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge import schemas
from scanforge.functions import binary
from scanforge.operators.compare import Comparison
from scanforge.plans import pipeline, prediction
from scanforge.session import checkpointed
from scanforge.sources import files
from scanforge.streaming import scans as streaming


def spectrum(index, level, time, mz, intensity, packed):
    def array(values, name):
        raw = struct.pack(f"<{len(values)}d", *values)
        kind = "zlib compression" if packed else "no compression"
        data = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam accession="x" name="64-bit float"/><cvParam accession="x" name="{kind}"/><cvParam accession="x" name="{name}"/><binary>{data}</binary></binaryDataArray>'

    return (
        f'<spectrum index="{index}" id="s{index}"><cvParam accession="MS:1000511" name="ms level" value="{level}"/><cvParam accession="x" name="base peak m/z" value="{mz[0]}"/>'
        f'<cvParam accession="x" name="base peak intensity" value="{max(intensity)}"/><scanList><scan><cvParam accession="x" name="scan start time" value="{time}"/></scan></scanList>'
        f"<binaryDataArrayList>{array(mz, 'm/z array')}{array(intensity, 'intensity array')}</binaryDataArrayList></spectrum>"
    )


def test_mzml(spark, tmp_path):
    body = spectrum(0, 1, 0.5, [100.0, 101.0], [5.0, 7.0], True) + spectrum(1, 2, 0.6, [1.0], [1.0], False) + spectrum(2, 1, 0.7, [200.0], [9.0], False)
    (tmp_path / "a.mzML").write_text(f"<mzML><run><spectrumList>{body}</spectrumList></run></mzML>")
    got = files.read_mzml(spark, str(tmp_path / "a.mzML")).orderBy("ind").collect()
    assert [(r.ind, r.starttime, r.mzarray, r.intarray) for r in got] == [(0, 0.5, [100.0, 101.0], [5.0, 7.0]), (2, 0.7, [200.0], [9.0])]


def nibbles(values):
    """Half bytes of integers, as the format says: heads count leading halves of zeros or ones."""
    out = []
    for v in values:
        hexed = f"{v & 0xFFFFFFFF:08x}"
        lead = "f" if v < 0 else "0"
        gone = min(len(hexed) - len(hexed.lstrip(lead)), 7 if v < 0 else 8)
        out += [gone + (8 if v < 0 else 0), *(int(c, 16) for c in reversed(hexed[gone:]))] if v >= 0 or gone else [0, *(int(c, 16) for c in reversed(hexed))]
    out += [0] * (len(out) % 2)
    return bytes(a << 4 | b for a, b in zip(out[::2], out[1::2], strict=True))


def test_numeric_compressions():
    rng = np.random.default_rng(1)
    ints = [0, 1, 15, 16, 255, 2**31 - 1, -1, -16, -17, -(2**31), *rng.integers(-(2**31), 2**31, 200).tolist()]
    assert binary.nibble_integers(nibbles(ints)).tolist() == ints
    mz, point = np.sort(rng.uniform(300, 1500, 400)), 100_000.0
    fixed = np.rint(mz * point).astype(np.int64)
    steps = fixed[2:] - (2 * fixed[1:-1] - fixed[:-2])
    linear = struct.pack(">d", point) + fixed[:2].astype("<i4").tobytes() + nibbles(steps.tolist())
    assert np.abs(binary.decode_array(linear, [binary.LINEAR, "64-bit float"]) - mz).max() <= 0.5 / point + 1e-9
    assert np.array_equal(binary.decode_array(zlib.compress(linear), [binary.LINEAR + binary.PACKED_TOO]), binary.decode_array(linear, [binary.LINEAR]))
    counts = rng.integers(0, 10**6, 50)
    assert binary.decode_array(nibbles(counts.tolist()), [binary.INTEGER]).tolist() == counts.tolist()
    logged = struct.pack(">d", 3000.0) + np.rint(np.log1p(counts) * 3000).astype("<u2").tobytes()
    assert np.allclose(binary.decode_array(logged, [binary.LOGGED]), counts, rtol=1e-3, atol=1e-3)
    for n in (0, 1, 2):
        assert binary.decode_array(struct.pack(">d", point) + fixed[:n].astype("<i4").tobytes(), [binary.LINEAR]).tolist() == (fixed[:n] / point).tolist()
    assert binary.decode_array(np.arange(3, dtype="<i4").tobytes(), ["32-bit integer", "no compression"]).tolist() == [0, 1, 2]
    for names in (["zstd compression", "64-bit float"], ["no compression"], ["no compression", "zlib compression", "64-bit float"]):
        with pytest.raises(ValueError):
            binary.decode_array(b"", names)


def test_mzml_with_parameter_groups_equals_the_plain_form(spark, tmp_path):
    """The same spectra with their level and the arrays' kinds in groups; groups of one name differ between files."""
    spectra = [(0, 1, 0.5, [100.0, 101.0], [5.0, 7.0]), (1, 2, 0.6, [1.0], [1.0]), (2, 1, 0.7, [200.0], [9.0])]
    plain = "".join(spectrum(*s, False) for s in spectra)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.mzML").write_text(f"<mzML><run><spectrumList>{plain}</spectrumList></run></mzML>")
    (tmp_path / "grouped").mkdir()

    def grouped(s):
        data = [base64.b64encode(struct.pack(f"<{len(x)}d", *x)).decode() for x in s[3:]]
        arrays = "".join(f'<binaryDataArray><referenceableParamGroupRef ref="{g}"/><cvParam accession="x" name="no compression"/><binary>{d}</binary></binaryDataArray>' for g, d in zip(("mz", "int"), data, strict=True))
        return (
            f'<spectrum index="{s[0]}"><referenceableParamGroupRef ref="level{s[1]}"/><cvParam name="base peak m/z" value="{s[3][0]}"/><cvParam name="base peak intensity" value="{max(s[4])}"/>'
            f'<scanList><scan><cvParam name="scan start time" value="{s[2]}"/></scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'
        )

    def group(name, *params):
        return f'<referenceableParamGroup id="{name}">{"".join(params)}</referenceableParamGroup>'

    double = '<cvParam accession="x" name="64-bit float"/>'
    for file, own, first, second in (("a.mzML", spectra[:2], 1, 2), ("b.mzML", [(2, 2, *spectra[2][2:])], 2, 1)):
        # In the second file the groups' names and levels are exchanged.
        levels = group("level1", f'<cvParam name="ms level" value="{first}"/>') + group("level2", f'<cvParam name="ms level" value="{second}"/>')
        kinds = group("mz", '<cvParam name="m/z array"/>', double) + group("int", '<cvParam name="intensity array"/>', double)
        body = "".join(map(grouped, own))
        (tmp_path / "grouped" / file).write_text(f"<mzML><referenceableParamGroupList>{levels}{kinds}</referenceableParamGroupList><run><spectrumList>{body}</spectrumList></run></mzML>")
    a, b = (sorted(map(tuple, files.read_mzml(spark, str(tmp_path / d)).collect())) for d in ("plain", "grouped"))
    assert a == b and len(a) == 2
    odd = plain.replace("no compression", "brotli compression")
    (tmp_path / "odd.mzML").write_text(f"<mzML><run><spectrumList>{odd}</spectrumList></run></mzML>")
    with pytest.raises(Exception, match="unknown compression"):
        files.read_mzml(spark, str(tmp_path / "odd.mzML")).collect()


def test_a_rewritten_input_is_computed_again(spark, tmp_path):
    source, table, made = str(tmp_path / "in"), str(tmp_path / "kept"), []

    def total():
        return files.cached(spark, table, lambda: made.append(1) or spark.read.parquet(source).agg(F.sum("id").alias("s")), [source]).first().s

    spark.range(10).write.parquet(source)
    assert (total(), total(), len(made)) == (45, 45, 1)
    spark.range(20).write.mode("overwrite").parquet(source)
    assert (total(), total(), len(made)) == (190, 190, 2)
    (tmp_path / "kept" / "_inputs").unlink()
    assert (total(), len(made)) == (190, 3)


def test_fasta_tables_grid_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("p1", "ACDK"), ("p2", "EFR")], "id string, s string")
    files.write_fasta(df, str(tmp_path / "f"), "id", "s")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "f")).collect())) == [("p1", "ACDK"), ("p2", "EFR")]
    odd = spark.createDataFrame([("a->b", "AC"), ("x>", "G")], "id string, s string")
    files.write_fasta(odd.coalesce(1), str(tmp_path / "odd"), "id", "s")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "odd")).collect())) == [("a->b", "AC"), ("x>", "G")]
    files.write_table(df, str(tmp_path / "t"), ["id"])
    assert files.read_table(spark, str(tmp_path / "t")).count() == 2
    grid = files.parameter_grid(spark, rt_tol=[1.0, 2.0], mz_tol=[5.0, 6.0, 7.0])
    assert files.task_parameters(grid, 4)["mz_tol"] == 5.0
    assert grid.count() == 6 and grid.where("ArrayTaskID = 4").first()["rt_tol"] == 2.0
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or df).count() == 2
    assert made == [1]


def test_peptide_records(spark):
    df = spark.createDataFrame([("_(ac)AM(ox)CK_", 1.0), ("_(ac)AM(ox)CK_", 3.0), ("_AK_", 5.0), (None, 1.0)], "`Modified sequence` string, `Calibrated retention time` double")
    got = sorted(map(tuple, files.peptide_records(df).collect()))
    assert got == [("AK", "", 5.0), ("AMCK", "0|Acetyl|2|Oxidation|3|Carbamidomethyl", 2.0)]


def test_match_predictions(spark):
    m = spark.createDataFrame([(1, "A", 2, 5.0, 10.0), (2, "A", 2, 6.0, 20.0), (3, "B", 2, 1.0, 5.0)], "row long, seq string, charge int, t double, Intensity double")
    p = spark.createDataFrame([("A", 6.2)], "seq string, predicted_RT double")
    args = (m, p, ["seq"], "t", ["seq", "charge"])
    assert prediction.match_predictions(*args, None, ["row"]).count() == 3
    assert [r.row for r in prediction.match_predictions(*args, "closest", ["row"]).collect()] == [2]
    near = prediction.match_predictions(*args, 2.0, ["row"]).collect()
    assert [(r.row, r.Intensity, r.t) for r in near] == [(1, 30.0, 5.0)]
    with pytest.raises(ValueError):
        prediction.match_predictions(*args, "best", ["row"])


def small_run(spark):
    shape = [0.0, 1.0, 4.0, 1.0, 0.0]
    scans = []
    for s in range(20):
        level = max(0.0, 10 - abs(s - 10)) ** 2
        scans.append((s, s, 1, 0.0, 0.0, s * 0.1, [100 + 0.01 * k for k in range(5)] + [101 + 0.01 * k for k in range(5)], [level * 0.7 * x for x in shape] + [level * 0.3 * x for x in shape]))
    ref = [
        (1, "_AAK_", 2, None, 1.0, 0.8, 1.2, 1.0, [100.02, 101.02], [0.7, 0.3]),
        (2, "_CCK_", 2, "+", 1.0, 0.8, 1.2, 1.0, [300.0, 301.0], [0.7, 0.3]),
    ]
    columns = "id long, `Modified sequence` string, Charge int, Reverse string, `Calibrated retention time` double, `Calibrated retention time start` double, `Calibrated retention time finish` double, predicted_RT double, IsoMZ array<double>, IsoAbundance array<double>"
    exp = [("_AAK_", 2, 0.8, 1.2, 1.0, 1.0, 500.0, None), ("_DDK_", 2, 3.0, 4.0, 3.5, 3.5, 900.0, None)]
    return spark.createDataFrame(scans, schemas.SCANS), spark.createDataFrame(ref, columns), spark.createDataFrame(exp, schemas.EXPERIMENT)


def test_pipeline_end_to_end(spark, tmp_path):
    scans, ref, exp = small_run(spark)
    for name, df in (("scans", scans), ("ref", ref), ("exp", exp)):
        df.write.parquet(str(tmp_path / name))
    settings = {"scans": str(tmp_path / "scans"), "reference": str(tmp_path / "ref"), "experiment": str(tmp_path / "exp"), "out": str(tmp_path / "out"), "rt_tol": 0.8}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    config = pipeline.Config.read(spark, str(tmp_path / "c.json"))
    out = pipeline.run_pipeline(spark, config)
    act = out["activation"].collect()
    assert {r.id for r in act} == {1} and all(r.activation >= 0 and r.cos_dist < 0.2 for r in act)
    assert out["records"].count() == 20
    assert [r.id for r in out["merged"].collect()] == [1]
    assert out["matched_peaks"].where("matched").count() == 1
    assert {(r.reference, r.experiment, r.active): r.n for r in out["overlap"].collect()} == {(1, 1, 1): 1, (1, 0, 0): 1, (0, 1, 0): 1}
    lasso = pipeline.process_scans(scans, pipeline.with_search_range(ref, config), pipeline.Config(rt_tol=0.8, opt_algo="lasso_cd", alphas=[0.1]))["activation"].collect()
    assert {r.id for r in lasso} == {1}
    with pytest.raises(ValueError):
        pipeline.Config(opt_algo="lasso")
    with pytest.raises(ValueError):
        Comparison(ref, exp)


def test_three_runs_in_one_table_equal_three_jobs(spark):
    from scanforge.plans import runs

    scans, ref, _ = small_run(spark)
    config = pipeline.Config(rt_tol=0.8)
    # The runs differ in loudness, in times and in what is expected when.
    one = {
        "r1": (scans, ref),
        "r2": (scans.withColumn("intarray", F.transform("intarray", lambda x: x * 3)), ref),
        "r0": (scans.withColumn("starttime", F.col("starttime") * 1.5 + 0.2).where("scan_idx < 18"), ref.withColumn("predicted_RT", F.col("predicted_RT") * 1.5 + 0.2)),
    }
    all_scans, all_refs = None, None
    for name, (s, r) in one.items():
        s, r = s.withColumn("run", F.lit(name)), r.withColumn("run", F.lit(name))
        all_scans, all_refs = (s, r) if all_scans is None else (all_scans.union(s), all_refs.union(r))
    rounded = lambda row: str([round(x, 7) if isinstance(x, float) else x for x in row])
    got = runs.analyse_runs(all_scans, all_refs, config)
    want = {"activation": [], "peaks": [], "sum_minima": []}
    for name, (s, r) in one.items():
        r = pipeline.with_search_range(r, config)
        # Written once, as jobs do; else each table would be computed from the spectra again.
        steps = {"activation": checkpointed(pipeline.process_scans(s, r, config)["activation"])}
        steps |= pipeline.quantify(steps["activation"], s, r)
        for table, rows in want.items():
            rows += [rounded((name, *row)) for row in steps[table].collect()]
    for table, rows in want.items():
        assert sorted(rounded(row) for row in got[table].collect()) == sorted(rows) and rows, table
    shared = runs.analyse_runs(all_scans.where("run <> 'r0'"), ref, config)["activation"].select("run", "id").distinct().collect()
    assert {(r.run, r.id) for r in shared} == {("r1", 1), ("r2", 1)}
    with pytest.raises(Exception, match="must be from 0"):
        runs.analyse_runs(all_scans.withColumn("scan_idx", F.col("scan_idx") - 5), all_refs, config)["activation"].collect()


def test_a_job_of_two_runs_is_written_and_read_again(spark, tmp_path):
    from scanforge.plans import runs

    scans, ref, _ = small_run(spark)
    both = scans.withColumn("run", F.lit("x")).union(scans.where("scan_idx < 15").withColumn("run", F.lit("y")))
    both.write.parquet(str(tmp_path / "scans"))
    ref.write.parquet(str(tmp_path / "ref"))
    config = pipeline.Config(scans=str(tmp_path / "scans"), reference=str(tmp_path / "ref"), experiment=str(tmp_path / "ref"), out=str(tmp_path / "out"), rt_tol=0.8)
    first = runs.run_job(spark, config, only=["sum_raw"])["sum_raw"].collect()
    assert {(r.run, r.id) for r in first} == {("x", 1), ("y", 1)}
    at = (tmp_path / "out").rglob("_SUCCESS")
    before = {p: p.stat().st_mtime_ns for p in at}
    assert runs.run_job(spark, config, only=["sum_raw"])["sum_raw"].collect() == first and before
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("_SUCCESS")} == before


def test_nearest_scans_of_each_run(spark):
    from scanforge.operators.joins import nearest_scan

    rng = np.random.default_rng(3)
    scans = [(r, i, float(x)) for r in "ab" for i, x in enumerate(np.sort(rng.uniform(0, 10, 40)) + (r == "b") * 3)]
    points = [(r, k, float(rng.uniform(-2, 15))) for r in "abc" for k in range(50)] + [("a", 99, None)]
    got = {(r.run, r.k): r.t_scan for r in nearest_scan(spark.createDataFrame(points, "run string, k long, t double"), spark.createDataFrame(scans, "run string, scan_idx long, starttime double"), ["t"], by=["run"]).collect()}
    for run, k, x in points:
        own = [(abs(s - x), s, i) for r, i, s in scans if r == run] if x is not None else []
        assert got[run, k] == (min(own)[2] if own else None)


def test_other_settings_give_other_results(spark, tmp_path):
    """A second run in the same folder with other alphas, or another input, does not read the first one's tables."""
    scans, ref, exp = small_run(spark)
    louder = scans.withColumn("intarray", F.transform("intarray", lambda x: x * 3))
    for name, df in (("scans", scans), ("louder", louder), ("ref", ref), ("exp", exp)):
        df.write.parquet(str(tmp_path / name))
    base = {"reference": str(tmp_path / "ref"), "experiment": str(tmp_path / "exp"), "out": str(tmp_path / "out"), "rt_tol": 0.8, "opt_algo": "lasso_cd", "alpha_criteria": "min"}
    total = {}
    for name, alphas in (("scans", [0.1]), ("scans", [0.1, 5.0]), ("louder", [0.1])):
        config = pipeline.Config(scans=str(tmp_path / name), alphas=alphas, **base)
        total[config.name] = pipeline.run_pipeline(spark, config)["activation"].agg(F.sum("activation")).first()[0]
    assert len(total) == 3
    first, _, loud = total.values()
    assert loud > 2 * first
    again = pipeline.extract_peaks(spark, config)
    assert again["peaks"].where("id = 1").count() >= 1 and again["matched"].where("matched").count() == 1
    assert pipeline.Config(corr_thres=0.9).name != pipeline.Config(corr_thres=0.8).name and pipeline.Config(PS_cos_dist=False).name != pipeline.Config().name


def test_stream_equals_batch(spark, tmp_path):
    scans, ref, _ = small_run(spark)
    scans.repartition(3).write.parquet(str(tmp_path / "in"))
    config = pipeline.Config(rt_tol=0.8)
    ref = pipeline.with_search_range(ref, config)
    q = streaming.process_stream(streaming.read_scans(spark, str(tmp_path / "in"), 1), ref, config, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.scan_idx, r.id): round(r.activation, 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.scan_idx, r.id): round(r.activation, 6) for r in pipeline.process_scans(scans, ref, config)["activation"].collect()}
    assert got == want and want


def test_times_model(spark):
    df = spark.createDataFrame([("A" * i + "K", float(i)) for i in range(1, 15)], "s string, t double")
    model = prediction.fit_times(df, "s", "t")
    out = prediction.predict_times(model, df, "s").select(F.max(F.abs(F.col("t") - F.col("predicted_RT")))).first()[0]
    assert out < 1.0
