"""A restricted SELECT over one object, run by Spark SQL, with typed errors.

The object is the only relation, under the name S3Object (or S3Object.path for an array inside JSON). Parsing and
planning are Spark's. A statement is allowed if Spark's parsed plan is a chain of the allowed steps and no others, so
columns may have the names of clauses. Names in double quotes are identifiers.

Two rules of the dialect differ from Spark's: a string column that is compared with a number is read as a number (null
if it is none), and `/` of integral columns and literals is integral. Both are applied to plain operands (a column or a
literal), by the object's schema; for compound ones CAST and DIV say the same.
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class SelectError(ValueError):
    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


#: Spark's error conditions and the names that a caller of the restricted dialect gets. Fixed values.
KINDS = {
    "UNRESOLVED_COLUMN": "EvaluatorBindingDoesNotExist",
    "FIELD_NOT_FOUND": "EvaluatorBindingDoesNotExist",
    "AMBIGUOUS_REFERENCE": "AmbiguousFieldName",
    "AMBIGUOUS_COLUMN_OR_FIELD": "AmbiguousFieldName",
    "PARSE_SYNTAX_ERROR": "ParseSelectFailure",
    "UNRESOLVED_ROUTINE": "InvalidQuery",
    "WRONG_NUM_ARGS": "IncorrectSqlFunctionArgumentType",
    "DATATYPE_MISMATCH": "IncorrectSqlFunctionArgumentType",
    "CAST_INVALID_INPUT": "InvalidDataType",
    "UNSUPPORTED_DATATYPE": "InvalidDataType",
    "TABLE_OR_VIEW_NOT_FOUND": "DataSourcePathUnsupported",
    "UNSUPPORTED_FEATURE": "UnsupportedSqlOperation",
    "PATH_NOT_FOUND": "ObjectNotFound",
    "DATA_SOURCE_NOT_FOUND": "InvalidDataSource",
    "MALFORMED_CSV_RECORD": "CsvParsingError",
    "OPERATION_CANCELED": "Canceled",
    "UNABLE_TO_ACQUIRE_MEMORY": "ResourceExhausted",
    "INTERNAL_ERROR": "InternalError",
}

#: Words in the message of a failed read, for causes without a condition of their own, in the order they are tried.
READ_FAILURES = [
    (r"not in gzip format|unknown compression|incorrect header check|not bzip2", "InvalidCompressionFormat"),
    (r"unexpected end of (input|zlib|file)|EOFException|truncated", "TruncatedInput"),
    (r"parquet", "ParquetParsingError"),
    (r"json", "JsonParsingError"),
    (r"csv", "CsvParsingError"),
]

#: The parsed plan of an allowed statement, outermost step first.
ALLOWED = re.compile(r"(GlobalLimit LocalLimit )?(Sort )?(Project|Aggregate) (Filter )?(SubqueryAlias )?UnresolvedRelation")

#: Clauses that Spark can't parse either, or that leave no step of their own in the plan.
REFUSED = re.compile(
    r"\b(?:FETCH\s+(?:FIRST|NEXT)|TOP\s+\d|QUALIFY|PREWHERE|SETTINGS|FORMAT|INTO|CONNECT\s+BY|FOR\s+(?:UPDATE|SHARE|XML|JSON|BROWSE)|EXCLUDE\s*\(|LIMIT\s+\S+\s+BY|LIMIT\s+\S+\s*,)|\*\s*EXCEPT\s*\("
)
UNMARKED = re.compile(r"\b(?:ROLLUP|CUBE)\s*\(|\bGROUPING\s+SETS\b|\bWITH\s+(?:ROLLUP|CUBE)\b|\b(?:ORDER|GROUP)\s+BY\s+ALL\s*(?:$|LIMIT\b|ORDER\b)|\*\s*EXCEPT\s*\(|\(\s*(?:SELECT|WITH|FROM|VALUES)\b")
LITERALS = re.compile(r"('(?:[^']|'')*'|--[^\n]*|/\*.*?\*/)", re.S)


def _bare(sql: str) -> str:
    """The statement without strings, quoted names and comments, in upper case."""
    sql = re.sub(r"--[^\n]*|/\*(?!\+).*?\*/", " ", sql, flags=re.S)
    return re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", " q ", sql).upper()


def _outside(sql: str, change) -> str:
    """Applies a change of text outside of strings and comments."""
    return "".join(part if i % 2 else change(part) for i, part in enumerate(LITERALS.split(sql)))


def _quoted(sql: str) -> str:
    return _outside(sql, lambda part: re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", part))


def _refuse(what: str, kind: str = "UnsupportedSqlStructure"):
    raise SelectError(kind, what)


def check(sql: str) -> None:
    """Raises SelectError for statements outside the restricted dialect."""
    statements = [s for s in _bare(sql).split(";") if s.strip()]
    if len(statements) != 1:
        _refuse(f"{len(statements)} statements", "MultiStatement" if statements else "ParseSelectFailure")
    bare = statements[0].strip()
    if bare.split()[0] != "SELECT":
        _refuse(bare.split()[0])
    if found := UNMARKED.search(bare):
        _refuse(found[0])
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(_quoted(sql).strip().rstrip(";"))
    except ParseException as e:
        if found := REFUSED.search(bare):
            _refuse(found[0])
        raise SelectError("ParseSelectFailure", str(e).splitlines()[0]) from e
    steps = json.loads(plan.toJSON())
    kinds = [s["class"].rpartition(".")[2] for s in steps]
    if not ALLOWED.fullmatch(" ".join(kinds)):
        _refuse(" over ".join(kinds))
    if any(k == "Sort" and s["global"] is not True for k, s in zip(kinds, steps)):
        _refuse("SORT BY")
    if kinds[0] == "GlobalLimit" and not bare.rpartition("LIMIT")[2].strip().isdigit():
        _refuse("LIMIT takes a literal")
    source = re.findall(r"[^\[\], ]+", str(steps[-1]["multipartIdentifier"]))
    quoted = re.search(r"(?i)\bFROM\s+[`\"]", sql)
    if len(source) > 2 or (source[0] != "S3Object" if quoted else source[0].upper() != "S3OBJECT"):
        _refuse(".".join(source), "DataSourcePathUnsupported")


_NAME = r"(?<![\w.`])(?:\w+\.)?(?:`[^`]+`|[A-Za-z_]\w*)(?![\w`(.])"
_NUMBER = r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])"
_COMPARE = r"\s*(?:<=|>=|<>|!=|=|<|>)\s*"
_WHOLE = rf"(?:{_NAME}|(?<![\w.])\d+(?![\w.]))"


def _typed(sql: str, schema: T.StructType) -> str:
    """Numbers against string columns, and integral division (see above)."""
    kinds = {f.name.lower(): f.dataType for f in schema}
    kind = lambda name: kinds.get(name.rpartition(".")[2].strip("`").lower())
    before = lambda m: m.string[: m.start()].rstrip()[-1:]

    def numeric(m: re.Match, name: int) -> str:
        if not isinstance(kind(m[name]), T.StringType) or before(m) == "|":
            return m[0]
        return m[0].replace(m[name], f"try_cast({m[name]} AS DOUBLE)")

    def whole(m: re.Match) -> str:
        operands = re.split(r"\s*/\s*", m[0])
        integral = all(o.isdigit() or isinstance(kind(o), T.IntegralType) for o in operands)
        return m[0] if not integral or before(m) in tuple("*/%") else " div ".join(operands)

    def change(part: str) -> str:
        part = re.sub(rf"({_NAME}){_COMPARE}{_NUMBER}", lambda m: numeric(m, 1), part)
        part = re.sub(rf"{_NUMBER}{_COMPARE}({_NAME})", lambda m: numeric(m, 1), part)
        part = re.sub(rf"(?i)({_NAME})\s+(?:NOT\s+)?(?:BETWEEN\s+|IN\s*\(\s*){_NUMBER}", lambda m: numeric(m, 1), part)
        return re.sub(rf"{_WHOLE}(?:\s*/\s*{_WHOLE})+", whole, part)

    return _outside(sql, change)


def kind_of(error: Exception) -> str:
    """The name of an error, by its own condition or that of one of its causes (16 at most)."""
    for _ in range(16):
        if isinstance(error, PySparkException):
            condition = error.getCondition() or ""
        else:  # a failed task's error comes as the JVM's, with its condition in the message
            condition = (re.findall(r"\[([A-Z_]+(?:\.[A-Z_]+)*)\]", str(error)) or [""])[0]
        if condition.split(".")[0] in KINDS:
            return KINDS[condition.split(".")[0]]
        if condition.startswith(("FAILED_READ_FILE", "MALFORMED_RECORD", "CANNOT_READ_FILE")):
            return next((kind for words, kind in READ_FAILURES if re.search(words, str(error), re.I)), "InternalError")
        if error.__cause__ is None:
            break
        error = error.__cause__
    return "ParseSelectFailure" if isinstance(error, ParseException) else "InvalidQuery"


@contextmanager
def errors():
    """Names the errors of actions on a result too: `with errors(): rows = run(...).collect()`."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        raise SelectError(kind_of(e), str(e).splitlines()[0]) from e


def run(obj: DataFrame, sql: str, strict: bool = True) -> DataFrame:
    """Runs a SELECT over one object. Without strict, whatever Spark SQL allows over it."""
    if strict:
        check(sql)
        sql = _quoted(sql).strip().rstrip(";")
    view = f"object_{uuid.uuid4().hex}"
    sql = re.sub(r"(?i)\bFROM\s+`(S3Object)`", r"FROM \1", sql)
    path = re.search(r"(?i)\bFROM\s+S3Object\.(\w+)", sql)
    if path:
        obj = obj.selectExpr(f"inline({path[1]})")
    if strict:
        sql = _typed(sql, obj.schema)
    obj.createOrReplaceTempView(view)
    text = re.sub(r"(?i)\bS3Object(\.\w+)?\b(?!\s*\.)", f"{view} AS S3Object" if not re.search(r"(?i)\bFROM\s+S3Object(\.\w+)?\s+(AS\s+)?(?!WHERE|GROUP|ORDER|LIMIT)\w+", sql) else view, sql, count=1)
    try:
        return obj.sparkSession.sql(text)
    except (ParseException, AnalysisException) as e:
        raise SelectError(kind_of(e), str(e).splitlines()[0]) from e
