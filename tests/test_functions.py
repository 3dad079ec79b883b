import math

import pytest
from pyspark.sql import functions as F

from auditlake.functions import color, languages, paths, text, versions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, rows, fn, ddl="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ddl)
    return [r["y"] for r in df.select(fn(*[F.col(c) for c in df.columns]).alias("y")).collect()]


def test_contrast_levels_and_blends(spark):
    pairs = [("#000", "#fff"), ("#999", "#ffffff"), ("rgb(119, 119, 119)", "white"), ("hsl(0, 100%, 50%)", "#000"), ("rgba(0,0,0,0.5)", "#fff"), ("var(--x)", "#fff")]
    got = values(spark, pairs, lambda a, b: color.contrast(color.parse_color(a), color.parse_color(b)), "a string, b string")
    assert got[:4] == [21.0, 2.85, 4.48, 5.25] and 3.9 < got[4] < 4.0 and got[5] is None
    assert values(spark, [7.0, 4.5, 3.0, 2.9], color.wcag_level, "x double") == ["AAA", "AA", "AA large", "fail"]


def test_colours_and_lengths(spark):
    assert values(spark, ["#ABC", "#aabbcc", "teal", "rgb(10 20 30)", "#aabbccdd", "none"], lambda c: color.to_hex(color.parse_color(c))) == ["#aabbcc", "#aabbcc", "#008080", "#0a141e", "#aabbcc", None]
    assert values(spark, ["12px", "1.5rem", "9pt", "50%", "10vh", "0", ""], color.to_pixels) == [12.0, 24.0, 12.0, 8.0, None, 0.0, None]
    better = one(spark, color.suggest(color.parse_color(F.lit("#999999")), color.parse_color(F.lit("#ffffff")), 4.5))
    assert one(spark, color.contrast(color.parse_color(F.lit(better)), color.parse_color(F.lit("#fff")))) >= 4.5


def test_versions(spark):
    pairs = [("1.2.3", "1.2.3"), ("1.10.0", "1.9.9"), ("1.0.0-alpha", "1.0.0"), ("v2", "1.9"), ("1.0.0-beta", "1.0.0-alpha"), ("x", "1.0.0")]
    assert values(spark, pairs, versions.compare_versions, "a string, b string") == [0, 1, -1, 1, 1, None]
    assert values(spark, ["^1.2.3", ">=2.1 <3", "~4", "*", "latest"], versions.minimum_satisfying) == ["1.2.3", "2.1.0", "4.0.0", None, None]


@pytest.mark.parametrize(("version", "inside"), [("0.9.0", False), ("1.0.0", True), ("1.4.9", True), ("1.5.0", False), ("2.0.0", True), ("2.3.0", True), ("2.3.1", False), ("bad", False)])
def test_ranges_fold_in_version_order(spark, version, inside):
    events = "array(named_struct('introduced', '2.0.0', 'fixed', null, 'last_affected', '2.3.0'), named_struct('introduced', '1.0.0', 'fixed', '1.5.0', 'last_affected', null))"
    assert one(spark, versions.affected_by(F.lit(version), F.expr(events))) is inside


def test_first_fix_stays_on_the_branch(spark):
    fixes = F.array(F.lit("1.5.0"), F.lit("2.0.3"), F.lit("2.4.0"))
    assert [one(spark, versions.first_fix(F.lit(v), fixes)) for v in ("1.2.0", "2.0.0", "3.0.0")] == ["1.5.0", "2.0.3", "2.4.0"]


def test_cvss_against_published_scores(spark):
    vectors = [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N", 5.5), ("CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N", None)]
    assert values(spark, [v for v, _ in vectors], versions.cvss_base) == [s for _, s in vectors]


def test_paths(spark):
    assert values(spark, ["./a/b.js", "a//b.js ", "a\\b.js", "a/x/../b.js", "a/./b.js", "../a", "a..b/c.js", None], paths.normal_path) == ["a/b.js", "a/b.js", "a/b.js", "a/b.js", "a/b.js", "a", "a..b/c.js", None]
    assert one(spark, paths.ancestors(F.lit("a/b/c.js"))) == ["", "a", "a/b"] and one(spark, paths.ancestors(F.lit("c.js"))) == [""]
    assert values(spark, ["a/b.min.js", ".env", "x", "a/B.TS"], paths.extension) == [".js", "", "", ".ts"]


def test_addresses(spark):
    assert values(spark, ["https://a.b/x/?utm_source=1&q=2#f", "https://a.b/", "https://a.b/x?fbclid=1"], paths.normal_url) == ["https://a.b/x/?q=2", "https://a.b", "https://a.b/x"]
    assert values(spark, ["/", "a/", "//a//b/?q#f", "", None], paths.normal_route) == ["/", "/a", "/a/b", "/", "/"]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("/u/:id", "/u/7", True), ("/u/:id", "/u/7/x", False), ("/p/{id}", "/p/9", True), ("/a/<int:pk>", "/a/3", True), ("/f/**", "/f/a/b", True), ("/a.b", "/axb", False), ("/x", "/x/", True)])
def test_route_expressions(spark, pattern, path, fits):
    assert one(spark, F.regexp_like(F.lit(path), paths.route_regex(F.lit(pattern)))) is fits


def test_file_routes(spark):
    assert values(spark, ["index.tsx", "blog/[slug].tsx", "docs/[...all].js", "(shop)/cart/page.tsx", "about.html"], paths.file_route) == ["/", "/blog/:slug", "/docs/*", "/cart", "/about"]


def test_text(spark):
    t = F.lit("ab\ncd\nef")
    assert (one(spark, text.line_at(t, F.lit(4))), one(spark, text.column_at(t, F.lit(4)))) == (2, 2)
    assert values(spark, ["\t  x", "x", "", "  "], text.indent_width) == [6, 0, 0, 2]
    assert values(spark, ["  a = 'x'  + 12;", 'b("q", 3.5)'], text.normal_line) == ['a = "" + 0;', 'b("", 0)']
    assert math.isclose(one(spark, text.entropy(F.lit("aabb"))), 1.0) and one(spark, text.entropy(F.lit(""))) == 0.0
    masked = one(spark, text.redacted(F.lit("abcdefgh12345678")))
    assert masked.startswith("abcd") and "****" in masked and "12345678" not in masked
    assert one(spark, text.strip_tags(F.lit("<p>a <b>b</b></p><script>var x;</script><!-- c -->"))) == "a b"
    assert values(spark, [500, 2048, 5 * 1024 * 1024], text.format_bytes, "x long") == ["500 B", "2.0 KiB", "5.0 MiB"]
    assert values(spark, ['a: "\\d"', 'a: "\\n"', "a: '\\d'"], text.invalid_yaml_escape) == [True, False, False]
    assert values(spark, [0.5, -0.5, 1.49], text.half_up, "x double") == [1, 0, 1]


def test_languages(spark):
    names = ["a/b.ts", "x.blade.php", ".env.local", "Dockerfile", "Dockerfile.dev", "v.erb", "m.unknown", "App.vue"]
    assert values(spark, names, languages.detect_language) == ["typescript", "blade", "dotenv", "docker", "docker", "ruby", "unknown", "vue"]
    assert values(spark, ["typescript", "blade", "json"], languages.family_of) == ["js", "php", "json"]
