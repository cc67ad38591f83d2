from pyspark.sql import functions as F

from loomaudit.functions import text, url


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


def test_url_forms(spark):
    assert one(spark, "HTTPS://Ex.com/a/?q=1#x", url.comparison_form) == "https://ex.com/a"
    assert one(spark, "https://ex.com/", url.comparison_form) == "https://ex.com/"
    assert one(spark, "https://ex.com:443/a/?utm_source=f&b=2&gclid=3#x", url.identity_form) == "https://ex.com/a/?b=2"
    assert one(spark, None, url.comparison_form) is None
    assert one(spark, None, url.host_key) == "unknown"
    assert one(spark, "https://u@ex.com:8080/x", url.host_key) == "ex.com:8080"
    assert one(spark, "https://ex.com/2024/123/v2/one-two-three/x", url.pattern) == "/{date}/{id}/{version}/{slug}/x"
    assert one(spark, "https://ex.com", url.prefix) == "/"
    assert one(spark, "a.b.ex.com", url.parent_domains) == ["a.b.ex.com", "b.ex.com", "ex.com"]
    assert one(spark, "192.168.1.4", url.is_private_host) and not one(spark, "8.8.8.8", url.is_private_host)
    assert one(spark, "ex.com/x", url.coerce_schemeless) == "https://ex.com/x"
    assert one(spark, "mailto:a@b", url.should_skip)


def test_scope(spark):
    f = lambda u: url.in_scope(u, F.lit("https://ex.com"), exclude=["*/private/*"], domains=["other.org"])
    got = [one(spark, u, f) for u in ("https://ex.com/a", "https://ex.com/private/a", "https://x.other.org/", "https://z.com/")]
    assert [r["reason"] for r in got] == ["in_scope", "excluded", "in_scope", "other_host"]


def test_text(spark):
    assert one(spark, " a  b\nc ", text.word_count) == 3
    assert one(spark, None, text.word_count) == 0
    assert one(spark, "aé", lambda c: text.truncate_bytes(c, 2)) == "a"
    assert one(spark, "aab", text.entropy) == round(one(spark, "aab", text.entropy), 20) and abs(one(spark, "aab", text.entropy) - 0.918296) < 1e-5
    assert one(spark, "", text.entropy) == 0
    assert one(spark, "x" * 50, lambda c: text.clamp_id(c, 30)) != one(spark, "x" * 51, lambda c: text.clamp_id(c, 30))
    assert one(spark, "public, max-age=60, s-maxage=90", text.cache_lifetime) == 90
    assert one(spark, "max-age=5, immutable", text.cache_lifetime) == 31536000
    assert one(spark, "no-store", text.cache_lifetime) is None
    assert one(spark, "  ", text.normalized_hash) is None
