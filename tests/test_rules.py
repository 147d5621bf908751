import pytest

from leadweave.functions.rules import MailRules, NameRules, classify
from tests.conftest import values

SCHEMA = "raw_name string, company_name string, contacts struct<emails:array<string>,telegram:array<string>>"


def reasons(spark, rows, mail=MailRules(), names=NameRules()):
    df = spark.createDataFrame([(n, c, (e, t)) for n, c, e, t in rows], SCHEMA).coalesce(1)
    return values(classify(df, mail, names), "is_cis", "cis_reason")


def test_reasons(spark):
    rows = [("", "", ["shop@kiosk.ru"], []), ("Tkachenko", "", [], []), ("Natasha Hill", "", [], []), ("", "", [], ["elena_desk"]),
            ("", "Igor Works", [], []), ("", "", ["x@gmail.run"], []), ("", "", ["info@a.example", "pavel@b.example"], []), ("", "", ["info@x.ua"], []), ("", "", ["q@yandex.com"], [])]
    assert [r for _, r in reasons(spark, rows)] == [
        "Email CIS TLD match: .ru", "Name match: Slavic surname suffix in [tkachenko]", "Name match: Slavic name token [natasha]",
        "Telegram handle match: Slavic name token [elena]", "Company match: Slavic name token [igor]", "CIS mail provider match: mail.ru",
        "Email prefix match: Slavic name token [pavel]", "Email CIS TLD match: .ua", "CIS mail provider match: yandex."]


def test_no_match_for_system_and_common_local_parts(spark):
    locals_ = ["admin", "info", "support", "contact", "sales", "help", "billing", "justin", "main", "fin", "bin", "win", "domain"]
    assert set(reasons(spark, [("", "", [f"{p}@example.com"], []) for p in locals_])) == {(False, "")}


def test_more_names(spark):
    assert all(flag and reason for flag, reason in reasons(spark, [(n, "", [], []) for n in ["viktoriia", "victoria", "vlad", "bogdan", "danylo", "daria"]]))


def test_rule_sets_are_a_choice_of_the_caller(spark):
    row = [("Tkachenko", "", ["pavel@b.example"], ["elena_desk"])]
    assert reasons(spark, row, names=None) == [(False, "")]
    assert reasons(spark, row, mail=None)[0][0]
    with pytest.raises(ValueError):
        reasons(spark, row, None, None)
    with pytest.raises(TypeError):
        classify(spark.createDataFrame([], SCHEMA))
