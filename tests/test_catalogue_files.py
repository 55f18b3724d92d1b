import glob
import json
import os

import pytest

from ledgerspark.operators.catalogue import companies, products
from ledgerspark.sources import catalogue_files as files


def made(spark, start, end):
    firms = companies(spark, start, end)
    keyed = products(spark, firms, 3).join(firms.select("company_no", "company_id"), "company_no")
    return firms, keyed


def test_round_trip_of_a_catalogue(spark, tmp_path):
    firms, keyed = made(spark, 0, 7)
    manifest = files.write_catalogue(firms, keyed, str(tmp_path), "v1", {"models": ["a"]})
    got = files.load_catalogue(spark, str(tmp_path))
    assert got.manifest == manifest and manifest["rows"] == {"companies": 7, "products": 21} and manifest["provenance"] == {"models": ["a"]}
    assert sorted(got.products.collect()) == sorted(files.declared(keyed, "products").collect())
    assert sorted(r.company_id for r in got.companies.collect()) == sorted(r.company_id for r in firms.collect())
    lists = files.by_company(got.products).collect()
    assert len(lists) == 7 and all([p.sku_id for p in r.products] == sorted(p.sku_id for p in r.products) and len(r.products) == 3 for r in lists)


def test_units_are_written_again_and_only_sealed_ones_are_read(spark, tmp_path):
    path = str(tmp_path)
    for unit, (a, b) in enumerate([(0, 3), (3, 5), (5, 9)]):
        files.write_unit(*made(spark, a, b), path, unit)
    files.write_unit(*made(spark, 3, 5), path, 1)
    with pytest.raises(FileNotFoundError):
        files.load_catalogue(spark, path)
    with pytest.raises(ValueError, match="not written"):
        files.seal(spark, path, "v1", [0, 1, 7])
    with pytest.raises(ValueError, match="differ"):
        files.seal(spark, path, "v1", [1, 1])
    files.seal(spark, path, "v1", [1, 0])
    assert sorted(r.company_id for r in files.load_catalogue(spark, path).companies.collect()) == [f"c{i:06d}" for i in range(5)]
    # a unit that is written again opens the catalogue until it is sealed
    files.write_unit(*made(spark, 0, 3), path, 0)
    with pytest.raises(FileNotFoundError):
        files.load_catalogue(spark, path)


def test_changed_files_newer_layouts_and_bare_companies_are_refused(spark, tmp_path):
    path = str(tmp_path)
    firms, keyed = made(spark, 0, 4)
    with pytest.raises(ValueError, match="at least one"):
        files.write_catalogue(firms.limit(0), keyed, path, "v1")
    with pytest.raises(ValueError, match="c000002"):
        files.write_catalogue(firms, keyed.where("company_id <> 'c000002'"), path, "v1")
    files.write_catalogue(firms, keyed, path, "v1")
    part = sorted(glob.glob(f"{path}/products/unit-000000/*.parquet"))[0]
    for own in glob.glob(f"{path}/products/unit-000000/.*.crc"):  # the local file system's own sums, which stores lack
        os.remove(own)
    with open(part, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="not as sealed"):
        files.load_catalogue(spark, path)
    newer = json.loads(spark.read.text(f"{path}/manifest").first().value) | {"schema_version": files.LAYOUT + 1}
    spark.createDataFrame([(json.dumps(newer),)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError, match="layout"):
        files.load_catalogue(spark, path)
