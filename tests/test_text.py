import html
import random

from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions import entities, text
from leadweave.functions.lists import ordered_unique
from leadweave.functions.rules import NameRules, name_reason
from leadweave.functions.sql import register
from tests.conftest import values

NOTE = ("Reach Ana.Prieto@Kettle.example or press@kettle.example; icon@3x.webp is no address. Channel t.me/Kettle_News (same as @kettle_news), not @share and not t.me/addstickers. "
        "Profile linkedin.com/company/kettle-9! Posts x.com/KettleHQ, x.com/intent. Call skype:ana.p or live:kettle; chat discord.gg/kEttle7, ana#0420.")


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}").coalesce(1)


def apply(spark, items, fn, kind="string"):
    return values(column(spark, items, kind).orderBy("i").select(fn("v").alias("o")), "o")


def test_contacts_of_one_text(spark):
    c = apply(spark, [NOTE], text.extract_contacts)[0]
    assert c.emails == ["ana.prieto@kettle.example", "press@kettle.example"]
    assert c.telegram == ["kettle_news"]
    assert c.linkedin == ["linkedin.com/company/kettle-9"]
    assert c.twitter == ["kettlehq"]
    assert c.skype == ["skype:ana.p", "live:kettle"]
    assert c.discord == ["discord.gg/kEttle7", "ana#0420"]


def test_contact_traps(spark):
    raw = "about.me/johnsmith netflix.com/browse olive:oil jquery@3.6.0 @" + "a" * 40 + " x.com/" + "b" * 20 + " see affpaying linkedin.com/in/affpaying-x"
    c = apply(spark, [raw], text.extract_contacts)[0]
    assert c.telegram == ["johnsmith", "a" * 32]
    assert c.twitter == ["browse", "b" * 15]
    assert c.skype == ["live:oil"]
    assert c.emails == ["jquery@3.6.0"]
    assert c.linkedin == []


def test_very_long_host_does_not_overflow(spark):
    assert apply(spark, ["x@" + "a." * 100_000 + "com"], lambda v: F.size(text.emails(v))) == [1]


def test_long_punctuation_run_is_trimmed_in_linear_time(spark):
    run = "a" + "-" * 200_000 + "b" + "." * 1000
    assert apply(spark, [run], lambda v: F.length(text.clean_token(v))) == [200_002]


def test_clean_token(spark):
    assert apply(spark, ["..skype:alice.-", "_x_#.", "$a$", "«é».", "   (x) ", ""], text.clean_token) == ["skype:alice", "_x_#", "$a$", "é", "x", ""]


def test_ordered_unique(spark):
    lists = [["A", "b", "a", " ", "B", "c", "C"], [], ["x"], ["x", "Y"], ["é", "É"]]
    assert apply(spark, lists, ordered_unique, "array<string>") == [["A", "b", "c"], [], ["x"], ["x", "Y"], ["é"]]


def test_ordered_unique_against_a_loop(spark):
    rng = random.Random(1)
    lists = [[rng.choice("aAbBcC ") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    want = []
    for items in lists:
        seen: dict = {}
        for v in items:
            if v.strip():
                seen.setdefault(v.lower(), v)
        want.append(list(seen.values()))
    assert apply(spark, lists, ordered_unique, "array<string>") == want


def test_entities_like_the_standard_library(spark):
    items = ["a &amp;lt; &#64; &#x40; &copy; &#38;lt; &lt; &nosuch; &#150; &commat; &#1114112; &quot; &#128512; &#0; &#xD800;", "plain", "&&&", "&#64&#65;"]
    assert apply(spark, items, entities.decode_entities) == [html.unescape(v) for v in items]
    bare = ["&amp", "a&copy2 &copy=1 &copy;x&copy", "&notit; &notin; &not &ampamp; &amp;amp &AMPlt", "&nbsp&nbsp;&x &ampx;", "?a=1&lt=2&gtx &hearts &hearts;"]
    assert apply(spark, bare, entities.decode_entities) == [html.unescape(v) for v in bare]
    assert apply(spark, bare, lambda v: entities.decode_entities(v, in_attribute=True)) == ["&", "a&copy2 &copy=1 ©x©", "&notit; ∉ ¬ &ampamp; &amp &AMPlt", "&nbsp\xa0&x &ampx;".replace("&nbsp", "\xa0", 1), "?a=1&lt=2&gtx &hearts ♥"]
    table = [" ".join("&" + name for name in entities.html5)]
    assert apply(spark, table, entities.decode_entities) == [html.unescape(table[0])]
    assert apply(spark, ["&#64; &amp;#64; &lt;b&gt; &#39;"], lambda v: entities.decode_entities(v, True)) == ["@ &amp;#64; &lt;b&gt; &#39;"]


def test_handles_and_domains(spark):
    assert apply(spark, ["@Moss_Desk", "https://t.me/Moss_Desk#top", "telegram.me/fern/q", "  ", "http://www.telegram.dog/@x y"], text.normalize_handle) == ["moss_desk", "moss_desk", "fern", "", "x"]
    assert apply(spark, [" desk@Kettle.Example ", "x", "a@b@C", "tail@"], text.mail_domain) == ["kettle.example", "", "b@c", ""]


def test_lists_and_statuses(spark):
    assert apply(spark, ["a, b ,,c", "  ", " x"], text.split_list) == [["a", "b", "c"], None, ["x"]]
    parsed = apply(spark, ["@a:[VALID], @@b:[X]], bad, c:[Y"], text.parse_statuses)[0]
    assert [tuple(p) for p in parsed] == [("a", "VALID"), ("@b", "X]"), ("c", "Y")]
    results = [[("u", "VALID"), ("v", "DELETED")], []]
    kind = "array<struct<username:string,status:string>>"
    assert apply(spark, results, text.status_text, kind) == ["@u:[VALID], @v:[DELETED]", ""]
    assert apply(spark, results, lambda v: text.status_text(v, "N/A"), kind) == ["@u:[VALID], @v:[DELETED]", "N/A"]
    assert apply(spark, results + [[("w", "INVALID")]], text.status_class, kind) == ["valid", None, "invalid"]


def test_parse_time(spark):
    got = apply(spark, ["2024-01-02 03:04:05", "2024-01-02T03:04:05.123+02:00", "x", "2024-13-02 03:04:05", "2024-01-02T03:04:05Z"], lambda v: text.parse_time(v).cast("string"))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 01:04:05.123", None, None, "2024-01-02 03:04:05"]


def test_sql_functions_equal_the_columns(spark):
    register(spark)
    items = ["..skype:alice.-", " @Name/x ", "a@B.c ", "«é»"]
    df = column(spark, items)
    got = values(df.selectExpr("clean_token(v)", "normalize_handle(v)", "mail_domain(v)"), "*")
    assert got == values(df.select(text.clean_token("v"), text.normalize_handle("v"), text.mail_domain("v")), "*")
    names = column(spark, ["Tkachenko", " Natasha Hill", "Ann Lee", "", None, "the ivanov-group"])
    assert values(names.selectExpr("name_reason(v)"), "*") == values(names.select(name_reason(F.col("v"), NameRules())), "*")
    assert len(fixed.SPACE_CHARS) == 25
