import json

import pytest

from codelode.sources import rest


def commit(sha):
    return {"sha": sha, "commit": {"author": {"name": "n", "email": "e@x", "date": "2024-01-01T00:00:00Z"}, "message": f"m {sha}"}}


def client(answers, **kw):
    asked = []

    def send(url, headers):
        asked.append((url, headers))
        a = answers[len(asked) - 1]
        if isinstance(a, Exception):
            raise a
        return a

    return rest.Client("http://h", send=send, sleep=lambda s: None, now=lambda: 100.0, **kw), asked


def test_pages_follow_links():
    c, asked = client([(200, {"link": '<http://h/2>; rel="next"'}, json.dumps([commit("a")])), (200, {}, json.dumps([commit("b")]))], token="t")
    assert [r[1] for r in c.commits("o/r")] == ["a", "b"]
    assert asked[1][0] == "http://h/2" and asked[0][1]["Authorization"] == "Bearer t"


def test_retries_and_limits():
    c, _ = client([OSError("x"), (503, {}, ""), (200, {}, "[]")])
    assert list(c.commits("o/r")) == [] and c.waited == 3.0
    c, _ = client([(429, {"retry-after": "5"}, ""), (200, {}, "[]")])
    assert list(c.commits("o/r")) == [] and c.waited == 5.0
    c, _ = client([(403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "1000"}, "")])
    with pytest.raises(rest.RateLimited):
        list(c.commits("o/r"))
    c, _ = client([(404, {}, "no")])
    with pytest.raises(ValueError, match="404"):
        list(c.commits("o/r"))
    c, _ = client([OSError("x")] * 3)
    with pytest.raises(OSError):
        list(c.commits("o/r"))


def test_source_reads_recorded_pages(spark, tmp_path):
    base = "http://h/repos/{}/commits?per_page=100"
    pages = {base.format("o/a"): {"headers": {"link": '<http://h/next>; rel="next"'}, "body": [commit("1")]}, "http://h/next": {"body": [commit("2")]}, base.format("o/b"): {"body": []}}
    (tmp_path / "pages.json").write_text(json.dumps(pages))
    rest.register(spark)
    df = spark.read.format("host_commits").option("repositories", "o/a, o/b").option("host", "http://h").option("pages", str(tmp_path / "pages.json")).load()
    assert sorted(r.sha for r in df.collect()) == ["1", "2"]
