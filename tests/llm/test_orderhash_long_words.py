import random
import re

from pyspark.sql import functions as F

from custaris.llm import orderhash as oh


def likenesses(spark, pairs):
    d = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return [r[1] for r in d.select("k", oh.likeness(oh.fingerprint(F.col("a")), oh.fingerprint(F.col("b")))).orderBy("k").collect()]


def test_one_edit_in_a_text_without_spaces(spark):
    r = random.Random(3)
    han = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
    url = "https://host.example/" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(1500))
    rare = "".join(chr(r.randrange(0x20000, 0x2A6DF)) for _ in range(600))      # outside the basic plane
    other = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
    pairs = [(han, han[:40] + "啊" + han[40:]), (han, han[:40] + han[41:]), (url, url[:30] + "x" + url[30:]),
             (rare, rare[:20] + "啊" + rare[20:]), ("see " + url + " there", "look, see " + url + " there"), (han, other), (han, han[2000:] + han[:2000])]
    got = likenesses(spark, pairs)
    assert min(got[:3]) > 0.9 and min(got[3:5]) > 0.8 and got[5] == 0 and 0.2 < got[6] < 0.8


def test_tokens(spark):
    def want(text):
        out = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", text):
            out += [w[i:i + oh.WINDOW] for i in range(len(w))] if len(w) > 48 else [w[i:i + 16] for i in range(0, len(w), 16)]
        return out
    long = "".join(chr(0x4E00 + k) for k in range(49))
    texts = ["", " \n", "a b", "x" * 48, "x" * 49, f"a {long} b {'y' * 40} z", f"{long} {long[:48]}", long + "😀" + long]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[0] for r in d.orderBy("k").select(oh.tokens(F.col("t"))).collect()] == [want(t) for t in texts]
