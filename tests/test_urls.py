import ipaddress
import posixpath
import random
from urllib.parse import unquote

from pyspark.sql import functions as F

from telemetra.functions import urls


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn("v").alias("o")).orderBy("i").collect()]


def verdict(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    bad = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
    return "blocked" if bad else "public"


def test_literal_addresses(spark):
    r = random.Random(4)
    hosts = ["::", "::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fe80::1", "fec0::1", "fc00::", "ff02::1", "2001:db8::1"]
    hosts += ["2606:4700::1111", "2001:4:112::1", "2001:3::9", "2001:20::1", "2001:1::1", "2002::1", "2a00:1450:4001:81b::200e"]
    hosts += ["1:2:3:4:5:6:7:8", "2400:1:2:3:4:5:6:7", ":::", "1::2::3", "12345::", "2400:1:2:3:4:5:6:7:8", "2400::1:2:3:4:5:6:7"]
    hosts += ["example.com", "1.2.3", "1.2.3.256", "01.2.3.4", "192.0.0.9", "192.0.0.8", "100.64.0.1", "255.255.255.255"]
    hosts += [".".join(str(r.choice([0, 10, 127, 169, 172, 192, 198, 203, 224, 254, 16, 31, 168, 8, 99])) for _ in range(4)) for _ in range(300)]
    hosts += [":".join(format(r.choice([0x2001, 0xDB8, 0xFE80, 0xFC01, 0, 1, 0x3FFF, 0x64]), "x") for _ in range(8)) for _ in range(200)]
    got = run(spark, hosts, lambda c: urls.literal_ip_verdict(F.col(c)))
    for h, g in zip(hosts, got):
        if h.startswith("3fff:") or h.startswith("64:"):
            continue  # newly assigned ranges that not every Python release lists
        assert g == verdict(h), h


def test_relative_paths(spark):
    cases = ["", "/", "a/b", "/a/../b", "/a/./b//c", "/../x", "/a%2Fb", "/a%2e%2e/c", "/a+b", "//evil", "///x", "/a/..", "/a/b/"]

    def want(path):
        decoded = unquote(path or "/")
        decoded = decoded if decoded.startswith("/") else "/" + decoded
        out = posixpath.normpath(decoded)
        return None if out.startswith("//") else out

    assert run(spark, cases, urls.clean_relative_path) == [want(c) for c in cases]


def test_paths_and_origins(spark):
    cases = ["", "users", "/users/", "https://h.example/x/", "https://h.example", "/a//", "http://h/x?q=1#f", "//h/p"]
    assert run(spark, cases, urls.normalise_path) == ["/", "/users", "/users", "/x", "/", "/a", "/x", "/p"]
    cases = ["HTTPS://User@Host.Example:8443/x", "http://[::1]:80/", "ftp://h/", "http://localhost/", "http:///x", "https://h:99999/"]
    assert run(spark, cases, urls.host)[:2] == ["host.example", "::1"]
    assert run(spark, cases, urls.port)[:2] == [8443, 80]
    faults = run(spark, cases, urls.origin_fault)
    assert faults == [
        None,
        None,
        "Only http/https URLs are allowed",
        "Local/internal targets are not allowed",
        "Invalid target URL",
        "Invalid target URL",
    ]


def test_join_url(spark):
    got = run(spark, ["https://h", "https://h/", "https://h/base", "https://h/base/", "nohost"], lambda c: urls.join_url(c, F.lit("/p ")))
    assert got == ["https://h/p", "https://h/p", "https://h/p", "https://h/base/p", None]
