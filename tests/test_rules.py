"""Patterns, thresholds and settings at their limits."""

import pytest

from leaksieve import ScanConfig, any_of, complexity_filter, entropy_filter, regex_filter, scan
from leaksieve.functions.regexes import check_pattern
from leaksieve.operators.scan import scan_literals
from leaksieve.plans.run import effective_filter
from leaksieve.session import scratch_dir

SECRET = "aB3$kL9@mX2#pQ5!rT8&nV1^wY4*uI7"


@pytest.mark.parametrize("pattern", ["a++", "a*+", "a{2}+", "x?+", r"(a)\1", r"(?P<n>a)\k<n>", "(?x)a b", "(?U)a", r"\Ga"])
def test_what_re2_refuses_is_refused(spark, pattern):
    with pytest.raises(ValueError):
        check_pattern(pattern)


@pytest.mark.parametrize("pattern", [r"a\++", "[*+]+", "(?i)a", "(?im:a)", "(?i-s)a", r"\Q++\E", r"(?P<name>a)+", "a+?", r"[\d+]+", r"a\\+"])
def test_what_re2_takes_is_taken(spark, pattern):
    assert check_pattern(pattern)


def test_a_threshold_beyond_any_token(spark, files_of):
    files = files_of({"f": SECRET})
    for mode in ("standard", "compat"):
        assert scan(files, entropy_filter(32, mode)).count() == 0
        assert scan(files, entropy_filter(4.5, mode)).count() == 1


def test_entropy_mode_of_the_settings(spark, files_of):
    files = files_of({"f": "你好世界"})
    found = {mode: scan(files, effective_filter(ScanConfig(entropy_limit=1.5, entropy_mode=mode))).count() for mode in ("compat", "standard")}
    assert found == {"compat": 0, "standard": 1}


def test_members_share_a_pass_over_the_tokens(spark, files_of):
    both = any_of(complexity_filter(), entropy_filter(3.0))
    plan = scan(files_of({"f": SECRET}), both)._jdf.queryExecution().optimizedPlan().toString()
    where = plan[plan.index("Filter") :]
    assert where.count("regexp_extract_all(text") == 1
    assert scan(files_of({"f": SECRET, "g": "abcdefghij", "h": "aaa"}), both).count() == 2


def test_literals_have_their_byte(spark, files_of):
    text = 'é = "' + SECRET + "\" + 'ü' ; b = `" + SECRET + "`\n\t'" + SECRET + "'"
    rows = scan_literals(files_of({"a.py": text}), entropy_filter(4.0)).collect()
    lines = text.encode().split(b"\n")
    assert [(r.line_no, r.unit_no) for r in rows] == [(1, 1), (1, 3), (2, 1)]
    for r in rows:
        assert lines[r.line_no - 1][r.byte_col :].startswith(SECRET.encode())


def test_one_rule_after_another(spark, files_of):
    assert scan(files_of({"f": "x key1"}), any_of(regex_filter("a", "key[0-9]"), regex_filter("b", "^x$"))).count() == 2


def test_no_folder_is_made_up(spark):
    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            class _jsc:
                @staticmethod
                def sc():
                    return Bare

    Bare.getCheckpointDir = staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Bare, "x")
