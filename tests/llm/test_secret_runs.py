from geoweft.llm import secretscan

KEY, OTHER = "wJalrXUtnFEMIK7MDENGbPxRfiCYzEX4MPLEKEY9", "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def found(spark, text):
    docs = spark.createDataFrame([(1, text, "src/app.py")], "doc_id bigint, text string, source string")
    return {r["cand"]: r for r in secretscan.candidates(docs).collect()}


def test_env_style(spark):
    got = found(spark, f"export AWS_SECRET_ACCESS_KEY={KEY} now")
    assert set(got) == {"AWS_SECRET_ACCESS_KEY=", KEY}
    r = got[KEY]
    assert (r["word_no"], r["before"], r["before2"], r["after"]) == (2, "AWS_SECRET_ACCESS_KEY=", None, "now")
    assert got["AWS_SECRET_ACCESS_KEY="]["before"] == "export" and got["AWS_SECRET_ACCESS_KEY="]["after"] is None


def test_minified_json(spark):
    got = found(spark, f'{{"checksum":"{OTHER}","api_token":"{KEY}"}}')
    assert set(got) == {KEY, OTHER}
    assert got[KEY]["before"] == '"api_token":' and got[KEY]["raw"] == f'"api_token":"{KEY}"' and got[OTHER]["before"] == '"checksum":'


def test_urls_and_lists(spark):
    got = found(spark, f"https://hostname.example.com/login?token={KEY} keys: {KEY[:20]},{OTHER}")
    assert set(got) == {"//hostname.example.com/login", KEY, KEY[:20], OTHER} and got[KEY]["before"] == "token="
    assert got[OTHER]["before"] == got[KEY[:20]]["before"] == "keys:"


def test_later_runs_are_judged(spark):
    forest = secretscan.grown(secretscan.example_findings(spark, 4000), trees=9)
    texts = [(1, f"export AWS_SECRET_ACCESS_KEY={KEY} now", "src/app.py"), (2, f'{{"user_identifier_name":"x","api_token":"{KEY}"}}', "src/app.py")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    got = {(r["doc_id"], r["length"]): r["kept"] for r in secretscan.scanned(docs, forest).collect()}
    assert got[1, 40] and got[2, 40]
