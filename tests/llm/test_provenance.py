import pytest

from auditlake.llm.provenance import classify, not_by_hand, path_says

CODE = "function load(a) {\n  return a.map((x) => x.name);\n}\n" * 12


@pytest.mark.parametrize("path", ["node_modules/a/b.js", "x/vendor/lib/a.php", "ios/Pods/a/b.m", "third_party/a.c", "dist/a.js", "public/build/a/b.rb", "target/classes/a.java", "bin/Debug/a.cs", "app/package-lock.json", "a/b.min.js", "a/b.pb.go", "a/b_pb2.py", "a/b.g.dart", "web\\vendored\\a.py", "venv/lib/site-packages/x/a.py"])
def test_paths_of_made_files(path):
    assert path_says(path) and not_by_hand(path, CODE)


@pytest.mark.parametrize("path", ["src/vendors/a.php", "app/vendor_portal/a.py", "scripts/build/a.sh", "src/dist_panel/a.js", "src/a/dist_b.ts", "src/minify/a.ts", "lib/a.js", "bin/cli.js", "src/generated_report_a.py", "src/bundle/a.js", "tests/a.js", "src/table_lock.ts", None, ""])
def test_similar_names_are_no_case(path):
    assert not path_says(path) and not not_by_hand(path, CODE)


@pytest.mark.parametrize("notice", ["// Code generated by x-gen v1.2.3. DO NOT EDIT.", "# AUTOGENERATED - run `make x` to refresh", "/* <auto-generated> x 1.0 */", " * @generated by x on 2025-03-01", "// Diese Datei wurde maschinell erzeugt (x).", "<!-- This file was automatically created from x.schema; changes will be lost. -->", "// Vendored from x@1.2.3, upstream copy", "/* X.js v4.5.3 | (c) X.js contributors | MIT licence */", "# X, version 0.2.4. Copyright the X authors. BSD licence.", "// Fichier produit par l'outil x, ne pas modifier.", "// Warning: this file is automatically generated", "/*!\n * X JavaScript Library v3.6.0\n * https://x.example/\n *\n * Copyright X and other contributors\n * Released under the MIT license\n */", "/*! X v3.6.0 | (c) X | x.example/license */"])
def test_notices_in_comments(notice):
    assert not_by_hand("src/a.js", notice + "\n" + CODE)


@pytest.mark.parametrize("line", ['out.write("// Code generated. DO NOT EDIT.\\n" + x);', "a = '@generated' + b;", "// do not edit the order below without a review", "# keep the generated report next to x", "// this module was written by hand after the generated one was dropped", "# inspired by a vendored x, rewritten for this project", "// Copyright the shop team. Internal licence, all rights kept.", "// This module checks that files were automatically generated by our tools.", "// see the file generated by the build", "// reads what was produced by x"])
def test_talk_of_such_things_is_no_case(line):
    assert not not_by_hand("src/a.js", line + "\n" + CODE)


def test_shapes():
    assert not_by_hand("web/a.js", "function a(b,c){return b?c:b.d}var e=f.g(h),i=j;" * 40)
    assert not_by_hand("src/a.py", "TABLE = [\n" + "  4411, 2210, 99123, 1, 5,\n" * 90 + "]\n")
    assert not_by_hand("src/a.ts", "".join(f'export const CODE_{i:04d} = new Code({i * 17}, "Name_{i:04d}");\n' for i in range(1, 60)))
    assert not not_by_hand("src/a.py", CODE + 'img = "data:image/png;base64,' + "iVBORw0KGgo" * 80 + '"\n')
    assert not not_by_hand("src/a.json", '{\n' + "".join(f'  "key{i}": "some words {i}",\n' for i in range(80)) + "}\n")


def test_table(spark):
    rows = [(1, "node_modules/a.js", None, "x", "js"), (2, None, "", None, None), (3, "a.js", "  \n", None, ""), (4, "vendor/a.js", CODE, None, "Js"), (4, "a.js", CODE, None, None), (5, None, "// @generated\n" + CODE, None, None)]
    df = spark.createDataFrame(rows, "file_id long, relative_path string, content string, not_by_hand string, language string")
    assert sorted((r.file_id, r.not_by_hand) for r in classify(df).collect()) == [(1, False), (2, False), (3, False), (4, False), (4, True), (5, True)]
    assert classify(df.limit(0)).count() == 0


def test_notices_count_at_the_margins_in_comments_of_the_language():
    assert not_by_hand("src/a.py", CODE + "# AUTOGENERATED - run `make x` to refresh\n")
    assert not not_by_hand("src/a.py", CODE + "# AUTOGENERATED - run `make x` to refresh\n" + CODE)
    assert not not_by_hand("a", "#autogenerated { margin: 0 }\n" + CODE, "css") and not_by_hand("a", "#autogenerated { margin: 0 }\n" + CODE, "Python")


def test_small_minified_files_and_versioned_copies():
    assert not_by_hand("web/a.js", "function a(b,c){return b?c:b.d}var e=f.g(h),i=j;" * 10)
    assert not_by_hand("libs/jquery-3.6.0.js", CODE) and not not_by_hand("docs/release-3.6.0.md", "Some words.\n")


def test_kept_columns(spark):
    df = spark.createDataFrame([("p", "a.js", CODE, None, [1, 2])], "project string, relative_path string, content string, language string, not_by_hand array<int>")
    assert classify(df, ("project",)).collect() == [("p", False)]
