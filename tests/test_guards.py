from pyspark.sql import functions as F

from sedimark.functions import guards, signing


def reasons(spark, urls, rules=guards.UrlRules()):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [r[1] for r in sorted(df.select("i", guards.url_rejection(F.col("u"), rules).alias("r")).collect(), key=lambda r: r[0])]


def test_urls(spark):
    urls = ["https://api.openai.com/v1", "https://sub.huggingface.co/x", "https://nothuggingface.co/", "gopher://a", "not a url", None, "http://192.168.1.1/", "http://[::1]/", "https://a@api.openai.com/", "https://api.openai.com/#%41", "http://0.0.0.0/"]
    assert reasons(spark, urls) == [None, None, "host", "scheme", "invalid_url", "invalid_url", "ip", "host", "credentials", "fragment", "ip"]


def test_rules_open_what_they_name(spark):
    rules = guards.UrlRules(cidrs=("8.8.8.0/24", "2001:db8::1"), allow_localhost=True, allow_private=True)
    assert reasons(spark, ["http://8.8.8.8/", "http://8.8.9.8/", "http://10.0.0.1/", "http://127.0.0.1:8080/", "http://127.0.0.1:22/", "http://localhost:6379/"], rules) == [None, "ip", None, None, "port", "port"]


def test_paths(spark):
    df = spark.createDataFrame([("a/b.bin",), ("../x",), ("/etc/passwd",), ("",), (None,), ("@a.bin",)], "p string")
    assert [r[0] for r in df.select(guards.path_rejection(F.col("p"), strip_at=True)).collect()] == [None, "path_traversal", "absolute_path", "empty", "empty", None]


def test_tokens(spark):
    # A published HMAC-SHA256 input (RFC 4231, case 2).
    assert signing.mac(b"what do ya want for nothing?", b"Jefe") == signing.b64url(bytes.fromhex("5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"))
    token = signing.mint({"sub": "x", "exp": 100}, b"k")
    assert [signing.verdict(token, b"k", 99), signing.verdict(token, b"k", 100), signing.verdict(token, b"other", 1), signing.verdict("a.b", b"k", 1), signing.verdict(None, b"k", 1)] == ["valid", "expired", "signature", "malformed", "malformed"]


def test_files_of_this_machine(tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abc")
    (tmp_path / "out.bin").write_bytes(b"abc")
    (tmp_path / "in/link").symlink_to(tmp_path / "out.bin")
    monkeypatch.chdir(tmp_path / "in")
    tried = {"a.bin": None, "@a.bin": None, "../in/a.bin": None, "../out.bin": "outside", "link": "outside", "none": "not_found", ".": "not_regular"}
    assert {p: guards.file_rejection(p) for p in tried} == tried and guards.file_rejection("a.bin", limit=2) == "too_large"
