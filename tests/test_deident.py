"""De-identification."""

from __future__ import annotations

import hashlib
import os
import platform
import random
import re
import shutil
import subprocess
import time
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from labmesh.functions import keyed
from labmesh.plans import deident
from tests.conftest import rows_of

SALT = "a-salt"


def people(spark, n=20):
    age = F.when(F.col("id") != 3, F.lit(30)).cast("int")
    return spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("ParticipantID"),
        F.concat(F.lit("Person "), "id").alias("Name"),
        (F.col("id") % 3).cast("int").alias("InstitutionID"),
        age.alias("Age"),
    )


def test_stretched_hash_equals_hashlib(spark):
    rows = deident.add_stretched_hash(people(spark, 5), "ParticipantID", SALT, iterations=1000).collect()
    for r in rows:
        expected = hashlib.pbkdf2_hmac("sha256", str(r.ParticipantID).encode(), SALT.encode(), 1000).hex()
        assert r.hashed_id == expected


def test_stretched_hash_default_cost(spark):
    (row,) = deident.add_stretched_hash(people(spark, 1), "ParticipantID", SALT).collect()
    assert row.hashed_id == hashlib.pbkdf2_hmac("sha256", b"1", SALT.encode(), 100_000).hex()


def test_stretched_hash_of_odd_values(spark):
    values = ["", "a" * 63, "a" * 64, "a" * 65, "\u00e9" * 40, None, "x", "x", None, "\u0000", "\U0001f600" * 200]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    for salt, iterations in ((SALT, 1), ("\u00fc" * 70, 7)):
        out = deident.add_stretched_hash(rows, "v", salt, iterations)
        assert out.columns == ["i", "v", "hashed_id"]
        hashes = [v and hashlib.pbkdf2_hmac("sha256", v.encode(), salt.encode(), iterations).hex() for v in values]
        hashes[0] = hashlib.pbkdf2_hmac("sha256", b"", salt.encode(), iterations).hex()
        assert sorted(out.collect()) == [(i, v, h) for i, (v, h) in enumerate(zip(values, hashes))]
    nothing = deident.add_stretched_hash(rows.where("v IS NULL"), "v", SALT).collect()
    assert [r.hashed_id for r in nothing] == [None, None]


def test_stretched_hash_of_many_batches(spark):
    n = 2 * deident.LANES + 1
    out = deident.add_stretched_hash(spark.range(n), "id", SALT, iterations=2, tasks=1).collect()
    assert sorted(r.id for r in out) == list(range(n))
    for r in out:
        assert r.hashed_id == hashlib.pbkdf2_hmac("sha256", str(r.id).encode(), SALT.encode(), 2).hex()


def test_stretched_hash_runs_side_by_side(spark):
    plan = deident.add_stretched_hash(people(spark), "ParticipantID", SALT)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "EvalPython" not in physical and physical.count("labmesh_stretched_hashes") == 1


def test_a_frequent_id_is_stretched_once_a_batch(spark):
    start = time.perf_counter()
    for _ in range(10):
        hashlib.pbkdf2_hmac("sha256", b"7", SALT.encode(), 100_000)
    one = (time.perf_counter() - start) / 10
    rows = spark.range(deident.LANES).select(F.lit(7).alias("id"))
    start = time.perf_counter()
    assert len({r.hashed_id for r in deident.add_stretched_hash(rows, "id", SALT).collect()}) == 1
    assert time.perf_counter() - start < one * deident.LANES / 3


@pytest.mark.skipif(shutil.which("javac") is None, reason="no Java compiler")
def test_the_jar_is_built_from_its_source(tmp_path):
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    source = keyed.STRETCHED_JAR.with_name("StretchedHash.java")
    subprocess.run(["javac", "--release", "17", "-proc:none", "-cp", jars, "-d", tmp_path, source], check=True)
    with zipfile.ZipFile(keyed.STRETCHED_JAR) as jar:
        classes = [name for name in jar.namelist() if not name.endswith("/")]
        assert classes == ["labmesh/StretchedHash.class"]
        # Other compilers of Java may write other bytes; that of Java 17 built the jar.
        if b" 17." in subprocess.run(["javac", "-version"], capture_output=True).stdout:
            assert jar.read(classes[0]) == (tmp_path / classes[0]).read_bytes()


def machine_code() -> bytes:
    with zipfile.ZipFile(keyed.KERNELS_JAR) as jar:
        (name,) = [name for name in jar.namelist() if not name.endswith("/")]
        assert name == "labmesh/stretched_kernels.so"
        return jar.read(name)


@pytest.mark.skipif(not all(map(shutil.which, ("rustc", "ld"))), reason="no Rust compiler or linker")
def test_the_machine_code_is_built_from_its_source(tmp_path):
    source = keyed.KERNELS_JAR.with_name("stretched_kernels.rs")
    built = tmp_path / "stretched_kernels.so"
    options = "--edition 2021 --crate-type lib -C opt-level=3 -C panic=abort -C relocation-model=pic"
    target = ["--target", "x86_64-unknown-linux-gnu"]
    emit = f"--emit=obj={tmp_path / 'kernels.o'}"
    subprocess.run(["rustc", *options.split(), *target, emit, source], check=True)
    link = "ld -shared -s --gc-sections -z noexecstack --build-id=none -o"
    subprocess.run([*link.split(), built, tmp_path / "kernels.o"], check=True)
    # Other compilers and linkers may write other bytes.
    rustc, ld = (subprocess.run([name, "--version"], capture_output=True).stdout for name in ("rustc", "ld"))
    if rustc.split(b"rustc ")[1].strip() in machine_code() and b" 2.40\n" in ld:
        assert built.read_bytes() == machine_code()


@pytest.mark.skipif((platform.system(), platform.machine()) != ("Linux", "x86_64"), reason="no machine code")
def test_every_kernel_does_as_the_loops(spark):
    deident.add_stretched_hash(people(spark, 1), "ParticipantID", SALT)  # the jars are there from now on
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    loader = spark._jsparkSession.artifactManager().classloader()
    kind = jvm.java.lang.Class.forName("labmesh.StretchedHash", True, loader)
    methods = {m.getName(): m for m in kind.getDeclaredMethods()}

    def call(name, *values):
        methods[name].setAccessible(True)
        given = gateway.new_array(jvm.Object, len(values))
        for i, value in enumerate(values):
            given[i] = value
        return methods[name].invoke(None, given)

    def words(draw, n):
        out = gateway.new_array(jvm.int, 8, n)
        for row in out:
            for i in range(n):
                row[i] = draw.randrange(-(2**31), 2**31)
        return out

    # The loops are number -1.
    kernel = call("kernel")
    supported = [kernel for kernel in range(3) if call("width", kernel) > 0]
    assert kernel in (supported or [-1])
    for kernel in supported:
        for n in (1, call("width", kernel), 2 * call("width", kernel) + 1):
            draw = random.Random(n)
            inner, outer = words(draw, n), words(draw, n)
            results = []
            for how in (-1, kernel):
                total = words(random.Random(5), n)
                call("iterate", how, inner, outer, total, 3)
                results.append([list(row) for row in total])
            assert results[0] == results[1]


def test_fast_hash(spark):
    (row,) = deident.add_hash(people(spark, 1), "ParticipantID", SALT).collect()
    assert row.hashed_id == hashlib.sha256(b"a-salt1").hexdigest()


def test_released_table(spark):
    source = people(spark)
    out = deident.anonymize_participants(source, deident.generate_mapping(source, SALT, iterations=10), SALT)
    assert out.columns == ["InstitutionID", "Age", "pseudonym", "hashed_id", "random_id"]
    rows = out.collect()
    assert len(rows) == len({r.pseudonym for r in rows}) == len({r.random_id for r in rows}) == 20
    assert all(re.fullmatch("P-[A-Z]{2}-[0-9]{2}-[0-9]{3}", r.pseudonym) for r in rows)
    assert all(100000 <= r.random_id <= 999999 for r in rows)
    ages = [r.Age for r in rows]
    assert ages.count(None) == 1 and all(28 <= a <= 32 for a in ages if a is not None) and len(set(ages)) > 2
    assert dict(out.dtypes)["Age"] == "int"


def test_same_output_for_any_partitioning(spark):
    one, many = people(spark).repartition(1), people(spark).repartition(8)
    release = lambda df: rows_of(deident.anonymize_participants(df, deident.generate_mapping(df, SALT, iterations=None), SALT))
    assert release(one) == release(many)


def test_another_salt_gives_another_mapping(spark):
    a, b = (rows_of(deident.generate_mapping(people(spark), s, iterations=None)) for s in ("x", "y"))
    assert not {r[1] for r in a} & {r[1] for r in b}


def test_the_permutation_is_one_to_one(spark):
    """Every place of the numeric range is used exactly once."""
    ids = spark.range(900_000)
    out = deident.add_random_id(ids, "id", SALT)
    stats = out.agg(F.count_distinct("random_id"), F.min("random_id"), F.max("random_id")).first()
    assert tuple(stats) == (900_000, 100_000, 999_999)


LARGE = [1, 900_001, 67_600_001, 500_000_000, 2**62]


def test_one_form_for_ids_of_any_size(spark):
    ids = spark.createDataFrame([(i,) for i in LARGE], "id long")
    names = [r.pseudonym for r in deident.add_pseudonym(ids, "id", SALT, groups=5).collect()]
    assert len(set(names)) == len(LARGE)
    assert all(re.fullmatch("P-[A-Z]{2}-[0-9]{2}(-[0-9]{3}){5}", n) for n in names)
    some = ids.where("id < 1000000000")
    numbers = [r.random_id for r in deident.add_random_id(some, "id", SALT, digits=12).collect()]
    assert len(set(numbers)) == 4 and all(len(str(n)) == 12 for n in numbers)


@pytest.mark.parametrize("id", [-1, 900_000, 67_600_000])
def test_an_id_without_room_is_an_error_that_names_it(spark, id):
    ids = spark.createDataFrame([(1,), (id,)], "id long")
    with pytest.raises(Exception, match=f"outside the domain of the released form: {id}"):
        deident.add_random_id(ids, "id", SALT).collect()
    if not 0 <= id < 67_600_000:
        with pytest.raises(Exception, match=f"outside the domain of the released form: {id}"):
            deident.add_pseudonym(ids, "id", SALT).collect()


def test_numbers_do_not_follow_the_ids(spark):
    ids = spark.range(3_000_000, 3_020_000)
    out = deident.add_random_id(ids, "id", SALT, digits=9)
    assert abs(out.stat.corr("id", "random_id")) < 0.03
    assert out.select("random_id").distinct().count() == 20_000


@pytest.mark.parametrize("groups", [1, 2, 3, 4, 5])
def test_wide_forms_are_one_to_one(spark, groups):
    a, b = keyed.readable_factors(groups)
    assert a * b == 676 * 10 ** (2 + 3 * groups)
    out = deident.add_pseudonym(spark.range(20_000), "id", SALT, groups=groups)
    assert out.select("pseudonym").distinct().count() == 20_000


def test_text_ids(spark):
    ids = spark.range(2000).select(F.concat(F.lit("K-"), "id").alias("ParticipantID"))
    first = deident.generate_mapping(ids.where("ParticipantID < 'K-5'"), SALT, iterations=None, digits=4)
    kept = {r.original_id: (r.pseudonym, r.random_id) for r in first.collect()}
    fresh = deident.extend_mapping(first, ids, SALT, iterations=None, digits=4).collect()
    both = [*kept.values(), *((r.pseudonym, r.random_id) for r in fresh)]
    assert len(both) == len({p for p, _ in both}) == len({n for _, n in both}) == 2000
    assert not kept.keys() & {r.original_id for r in fresh}
    assert all(1000 <= n <= 9999 and re.fullmatch("P-[A-Z]{2}-[0-9]{2}-[0-9]{3}", p) for p, n in both)
    again = deident.generate_mapping(ids.where("ParticipantID < 'K-5'").repartition(3), SALT, iterations=None, digits=4)
    assert {r.original_id: (r.pseudonym, r.random_id) for r in again.collect()} == kept


def test_too_many_text_ids(spark):
    ids = spark.range(9001).select(F.col("id").cast("string"))
    with pytest.raises(Exception, match="outside the domain of the released form: 9000"):
        deident.add_random_id(ids, "id", SALT, digits=4).collect()


def test_known_ids_keep_their_names(spark):
    first = deident.generate_mapping(people(spark, 20), SALT, iterations=None)
    fresh = deident.extend_mapping(first, people(spark, 25), SALT, iterations=None)
    assert sorted(r.original_id for r in fresh.collect()) == [21, 22, 23, 24, 25]
    whole = deident.generate_mapping(people(spark, 25), SALT, iterations=None)
    assert rows_of(first.unionByName(fresh)) == rows_of(whole)


def test_release_twice(spark, tmp_path):
    mapping, target = str(tmp_path / "mapping"), str(tmp_path / "released")
    first = rows_of(deident.release(people(spark, 20), mapping, target, SALT, iterations=None), "pseudonym")
    second = rows_of(deident.release(people(spark, 25), mapping, target, SALT, iterations=None), "pseudonym")
    assert len(first) == 20 and len(second) == 25 and set(first) <= set(second)
    assert spark.read.parquet(mapping).count() == 25


def test_release_of_nothing(spark, tmp_path):
    out = deident.release(people(spark).limit(0), str(tmp_path / "m"), str(tmp_path / "r"), SALT, iterations=None)
    assert out.collect() == [] and "pseudonym" in out.columns


def test_a_salt_is_required(spark):
    for salt in ("", None):
        with pytest.raises(ValueError):
            deident.generate_mapping(people(spark), salt)


def test_plans_do_not_print_the_salt(spark):
    secret = "very-secret-salt"
    source = people(spark)
    mapping = deident.generate_mapping(source, secret, iterations=None)
    out = deident.anonymize_participants(source, mapping, secret)
    slow = deident.add_stretched_hash(source, "ParticipantID", secret)
    for df in (out, slow):
        assert secret not in df._jdf.queryExecution().toString()


def test_k_anonymity(spark):
    rows = [("a", 1)] * 3 + [("a", None)] * 2 + [(None, None)] + [("b", 1)] * 4
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x string, y int")
    assert rows_of(deident.small_groups(df, ["x", "y"], 3)) == sorted([("a", None, 2), (None, None, 1)], key=repr)
    kept = deident.suppress_small_groups(df, ["x", "y"], 3, spread_by=["id"])
    assert [r[0] for r in rows_of(kept, "id")] == [0, 1, 2, 6, 7, 8, 9]


def test_noise_is_fixed_per_group_and_has_the_right_scale(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("g"), F.lit(10).alias("v"))
    once = deident.private_totals(df, ["g"], "v", bound=100, epsilon=1.0, salt=SALT)
    assert rows_of(once) == rows_of(deident.private_totals(df.repartition(3), ["g"], "v", 100, 1.0, SALT))
    mean, spread = once.agg(F.avg("NoisyCount"), F.avg(F.abs(F.col("NoisyCount") - 2))).first()
    # Laplace noise of scale 2 has mean absolute value 2.
    assert abs(mean - 2) < 0.3 and 1.8 < spread < 2.2


def test_values_are_clamped(spark):
    df = spark.createDataFrame([("a", 1e6), ("a", -5.0)], "g string, v double")
    (row,) = deident.private_totals(df, ["g"], "v", bound=1, epsilon=1e9, salt=SALT).collect()
    assert abs(row.NoisySum - 1) < 0.01


def test_registered_releases_hold_large_keys(spark, tmp_path):
    """Keys of a table of any size get a released id, the same as in SQL."""
    import duckdb

    from bindings.oracles import ORACLES
    from bindings.queries import REGISTRY
    from tools.compare import bag

    keys = [1, 899_999, 900_000, 1_500_000, 67_600_000, 10**8, 10**12, 9 * 10**13 - 1]
    rows = [(k, f"Customer#{k}", k % 25, float(k % 900), "BUILDING" if k % 2 else "FURNITURE") for k in keys]
    folder = str(tmp_path / "tables")
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    for name in ("anon_pseudonym", "anon_random_id", "anon_publish", "anon_incremental", "anon_release"):
        ours = REGISTRY[name](spark, folder).toPandas()
        assert bag(ours) == bag(db.execute(ORACLES[name]).df()) and len(ours) > 2
