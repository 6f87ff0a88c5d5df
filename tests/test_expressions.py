import pytest
from hypothesis import given, settings, strategies as st

from airloom import ExpressionError, TubeError, check_tube_data, get_tube_x
from airloom.functions.expressions import Compiler, parse, term

FRAME = [(1.0, "a", True, None), (2.0, "b", False, 5.0), (-5.5, None, None, 7.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(FRAME, "x double, `odd name` string, ok boolean, `.gap` double")


def values(df, text):
    return [r[0] for r in df.select(get_tube_x(df, text, if_err="stop<<t>>x")).collect()]


@pytest.mark.parametrize(("text", "wanted"), [
    ("1 + 2", [3.0] * 3), ("paste('a','b')", ["a b"] * 3), ("paste0('a', 'b')", ["ab"] * 3), ("paste('a', x, sep='-')", ["a-1", "a-2", "a--5.5"]),
    ("-x^2", [-1.0, -4.0, -30.25]), ("x %% 3", [1.0, 2.0, 0.5]), ("x %/% 3", [0.0, 0.0, -2.0]), ("2^3^2", [512.0] * 3), ("!x > 1", [True, False, True]),
    ("`odd name` == 'a'", [True, False, None]), ("ok & x > 0", [True, False, False]), ("ok | x > 0", [True, True, None]), ("x / 0", [None] * 3),
    ("ifelse(is.na(`odd name`), 'none', toupper(`odd name`))", ["A", "B", "none"]), (".gap + 1", [None, 6.0, 8.0]), ("mean(.gap, na.rm = TRUE)", [6.0] * 3), ("mean(.gap)", [None] * 3),
    ("sum(x)", [-2.5] * 3), ("x %in% c(1, -5.5)", [True, False, True]), ("sqrt(x)", [1.0, 2.0**0.5, None]), ("round(2.5)", [2.0] * 3), ("signif(123456, 2)", [120000.0] * 3),
    ("as.numeric('7')", [7.0] * 3), ("as.numeric('q')", [None] * 3), ("length(unique(`odd name`))", [3.0] * 3), ("substr('hello', 2, 3)", ["el"] * 3), ("nchar(paste0('ab', x))", [3.0, 3.0, 6.0]),
    ("trimws(' a\t')", ["a"] * 3), ("TRUE", [True] * 3), ("NA", [None] * 3), ("as.integer(2.9)", [2] * 3), ("1e3 == 1000L", [True] * 3),
])
def test_values(df, text, wanted):
    assert values(df, text) == wanted


@pytest.mark.parametrize("text", ["system('rm -rf /')", "__import__('os').getcwd()", "x +", "x y", "a$b", "x[1]", "rev(x)", "unique(x)", "nothere", "(x", "paste(x, collapse = ',')"])
def test_rejected(df, text):
    with pytest.raises(TubeError):
        values(df, text)
    assert get_tube_x(df, text) is None


def test_error_names_the_argument(df):
    with pytest.raises(TubeError, match="calc.*by"):
        term(df, "nothere", None, "stop<<calc>>by")


def test_kind_is_checked(df):
    assert term(df, "ok", "number") is None and term(df, "x", "number") is not None
    with pytest.raises(ExpressionError):
        Compiler(df).compile("paste(x")


def test_factor_levels(df):
    out = check_tube_data(df, ["factor(`odd name`, levels = c('b', 'a'))"])
    field = out.schema["factor(`odd name`, levels = c('b', 'a'))"]
    assert field.metadata["levels"] == ["b", "a"]
    assert values(df, "as.numeric(factor(`odd name`, levels = c('b', 'a')))") == [2.0, 1.0, None]
    assert check_tube_data(df, ["x", "nothere"], output="report") == ["x"]


def test_no_python_in_the_plan(df):
    plan = df.select(get_tube_x(df, "ifelse(x > 1, paste('a', x), 'b')"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.sampled_from(["1", "2.5", "x", "'t'"]), lambda e: st.builds("({} {} {})".format, e, st.sampled_from(["+", "-", "*", "<", "&", "%%"]), e) | st.builds("-{}".format, e), max_leaves=8))
def test_parsing_terminates(text):
    assert parse(text) == parse(f"({text})")
