"""Rules are mined from all tokens of a URL, however far behind."""

from tidewright.llm import urls


def test_a_token_after_the_twelfth_makes_a_rule(spark):
    front = lambda i: "/".join(f"{chr(97 + k)}{chr(97 + (i * 7 + k * 3) % 23)}" for k in range(14))
    rows = [(f"http://{chr(97 + i % 26)}x.com/{front(i)}/{'bad' if i % 2 else 'good'}", urls.BLOCK if i % 2 else urls.ALLOW) for i in range(46)]
    rules = urls.mine(spark.createDataFrame(rows, "url string, label string"), min_rows=20)
    assert (("p:bad",), urls.BLOCK) in {(r.tokens, r.verdict) for r in rules}
