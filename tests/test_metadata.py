from pyspark.sql import functions as F

from sedimark.functions import metadata as M


def values(spark, column, items, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", column(F.col("x")).alias("y")).collect())]


def test_scalar_functions(spark):
    assert values(spark, M.is_valid_version, ["1.2.3", "0.0.1", "abc", "1", "10000.1", "1.2.3.4.5.6", "a.b", "1." + "9" * 12]) == [True, True, False, False, False, False, True, True]
    assert values(spark, M.normalize_license_name, ["mit", "gpl3", "unknown", "Apache"]) == ["MIT", "gpl3", "unknown", "Apache-2.0"]
    assert values(spark, M.infer_license_from_text, ["Permission is hereby granted ... MIT", "Redistribution and use in source and binary forms", "the Apache License", "GNU General Public License", "x"]) == ["MIT", "BSD", "Apache-2.0", "GPL", None]
    assert values(spark, M.company_name, ["Company: Acme Corp, x", "copyright 2020 Foo Bar inc.", "company: A", "none"]) == ["Acme Corp", "2020 Foo Bar", None, None]
    assert values(spark, M.product_name, ["Product: Widget", "program: abc;", ""]) == ["Widget", "abc", None]
    assert values(spark, M.library_version, ["libcrypto.1.1.dylib", "a..b", "x"]) == ["1", "", None]
    assert values(spark, M.most_dotted, [["1.2", "1.2.3", "9.8.7"], []], "array<string>") == ["9.8.7", None]
    assert [tuple(v) for v in values(spark, M.unpack_version, [0x000A0F00], "int")] == [(10, 15)]


def test_version_and_license_info(spark):
    strings = [["version: 2.1.0", "Company: Acme", "v1.2.3-x"], ["SPDX-License-Identifier: MIT", "Copyright 2020 Acme", "Licensed under the Apache License, Version 2.0"], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s array<string>")
    rows = M.with_license_info(M.with_version_info(df, "s"), "s").orderBy("i").collect()
    v = rows[0].version_info
    assert (v.version_strings, v.file_version, v.company) == (["1.2.3", "2.1.0", "2.3"], "2.1.0", "Acme")
    assert abs(v.confidence - 0.8) < 1e-9
    li = rows[1].license_info
    assert li.licenses == ["Apache-2.0", "MIT", "apache license"] and li.spdx_identifiers == ["MIT"] and li.copyright_notices == ["Copyright 2020 Acme"]
    assert abs(li.confidence - 0.8) < 1e-9
    assert rows[2].version_info.confidence == 0.0 and rows[2].license_info.licenses == []


def test_cpe_candidates(spark):
    found = values(spark, M.cpe_candidates, [["libssl.3.so", "zlib.1.dll", "zlib", "x"]], "array<string>")
    assert found == [["cpe:2.3:a:openssl:openssl:3:*:*:*:*:*:*:*", "cpe:2.3:a:zlib:zlib:1:*:*:*:*:*:*:*"]]
