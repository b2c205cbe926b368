"""Names and classes of syntax nodes, and what a file's fragments are made of.

nodes: path, node_id (in document order), parent_id, child_idx, kind, is_named, field, text, start_byte, end_byte,
start_line, end_line, is_error, is_missing, is_extra. Any parser can fill it. Names and classes of nodes are column
expressions over small fixed vocabularies (callers can pass a larger one); ``treebags`` walks the trees.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Subtrees that are left out, and containers that are looked through.
SKIPPED = (
    "comment", "arraykey", "bool", "bottom_type", "decorator", "dynamic", "float", "generic_type", "int",
    "intersection_type", "lifetime", "lifetime_parameter", "primitive_type", "mixed", "named_type", "nonnull",
    "noreturn", "nothing", "num", "optional_type", "resource", "type_annotation", "type_arguments",
    "type_bound", "type_identifier", "type_parameter", "type_parameters", "type_specifier", "type_list",
    "union_type", "user_type",
)
TRANSPARENT = (
    "statement_list", "expression_list", "value_argument", "argument", "parenthesized_expression",
    "script_block_body", "pipeline", "pipeline_chain", "attribute_list", "attribute", "type_literal",
    "type_spec", "stmt", "select_no_parens", "simple_select", "a_expr", "a_expr_prec", "c_expr", "ColId",
    "ColLabel", "attr_name", "indirection", "indirection_el", "unreserved_keyword",
)
# Canonical name, kinds that have it. A seed of common kinds; ``vocabulary`` extends it.
CANONICAL = (
    ("function", (
        "function_definition", "function_declaration", "function_item", "function_expression",
        "arrow_function", "func_literal", "anonymous_function",
    )),
    ("function", (
        "constructor_declaration", "method_declaration", "method_definition", "lambda", "lambda_expression",
    )),
    ("block", ("block", "body", "statement_block", "compound_statement", "function_body")),
    ("parameters", ("parameters", "formal_parameters", "parameter_list")),
    ("parameter", ("parameter", "formal_parameter", "lambda_parameter", "script_parameter")),
    ("parameter:default", ("default_parameter",)),
    ("arguments", ("arguments", "argument_list", "value_arguments")),
    ("binding", ("variable_declarator", "let_declaration", "short_var_declaration", "variable_declaration")),
    ("collection", ("list", "tuple", "dictionary", "array", "object", "map", "dictionary_literal")),
    ("flow:if", ("if_statement", "if_expression", "if")),
    ("flow:else", ("else_clause",)),
    ("flow:loop", (
        "for_statement", "while_statement", "for_in_statement", "foreach_statement", "enhanced_for_statement",
    )),
    ("flow:switch", ("switch_statement", "match_expression", "match_block")),
    ("flow:case", ("switch_case", "match_arm", "switch_rule")),
    ("flow:return", ("return_statement", "return_expression", "return")),
    ("flow:break", ("break_statement",)),
    ("flow:continue", ("continue_statement",)),
    ("flow:defer", ("defer_statement",)),
    ("flow:try", ("try_statement", "try_expression")),
    ("flow:catch", ("except_clause", "catch_clause")),
    ("flow:yield", ("yield_expression",)),
    ("expression:call", (
        "call", "call_expression", "invocation", "invocation_expression", "method_invocation",
        "function_call_expression", "member_call_expression",
    )),
    ("expression:member", (
        "member_expression", "field_expression", "selector_expression", "member_access_expression",
        "navigation_expression",
    )),
    ("expression:index", ("subscript", "index_expression", "subscript_expression")),
    ("expression:slice", ("slice_expression",)),
    ("expression:binary", ("binary_expression", "binary_operator", "infix_expression")),
    ("expression:boolean", ("boolean_operator",)),
    ("expression:comparison", ("comparison_operator",)),
    ("expression:assignment", ("assignment", "assignment_expression", "assignment_statement")),
    ("expression:unary", (
        "unary_expression", "prefix_unary_expression", "postfix_unary_expression", "unary_operator",
    )),
    ("expression:conditional", ("ternary_expression", "conditional_expression")),
    ("expression:await", ("await_expression", "awaitable_expression")),
    ("expression:new", ("new_expression", "object_creation_expression")),
    ("symbol", (
        "identifier", "field_identifier", "function_name", "simple_identifier", "simple_name",
        "property_identifier", "shorthand_property_identifier", "name", "word", "variable_name",
    )),
    ("symbol:self", ("self", "this")),
    ("literal:boolean", ("boolean", "false", "true", "boolean_literal")),
    ("literal:character", ("char_literal", "character_literal")),
    ("literal:null", ("none", "null", "nil", "null_literal")),
    ("literal:pattern", ("regex", "regex_pattern")),
    ("literal:number", (
        "float_literal", "integer", "integer_literal", "number", "decimal_integer_literal",
        "hex_integer_literal",
    )),
    ("literal:number", (
        "octal_integer_literal", "binary_integer_literal", "decimal_floating_point_literal",
        "hex_floating_point_literal",
    )),
    ("literal:string", (
        "interpreted_string_literal", "raw_string_literal", "string", "string_literal", "template_string",
        "line_string_literal", "multi_line_string_literal",
    )),
    ("literal:string-part", ("string_content",)),
)
# Operator families, roles of fields and operation families of callees.
OPERATORS = (
    ("and", ("&&", "and")),
    ("or", ("||", "or")),
    ("not", ("!", "not")),
    ("equal", ("==", "===")),
    ("not-equal", ("!=", "!==")),
    ("ordered", ("<", "<=", ">", ">=", "<>")),
    ("membership", ("in",)),
    ("additive", ("+", "-")),
    ("multiplicative", ("*", "/", "//", "%")),
    ("power", ("**",)),
    ("bitwise", ("&", "|", "^", "<<", ">>")),
    ("assign", ("=", ":=")),
    ("compound-assign", ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")),
)
ROLES = (
    ("arguments", ("arguments",)),
    ("alternative", ("alternative",)),
    ("body", ("body",)),
    ("condition", ("condition",)),
    ("consequence", ("consequence",)),
    ("callee", ("function",)),
    ("index", ("index",)),
    ("operand", ("left", "lhs", "right", "rhs")),
    ("receiver", ("object", "operand")),
    ("parameters", ("parameters",)),
    ("value", ("value",)),
)
OPERATIONS = (
    ("aggregate", ("avg", "count", "group_concat", "groupconcat", "max", "min", "sum", "total")),
    ("parameter", ("arg", "narg", "slice")),
    ("membership", (
        "contains", "containskey", "containsvalue", "has", "haskey", "includes", "indexof", "str_contains",
    )),
    ("pattern-match", ("match", "matches", "matchstring", "search", "test")),
    ("length", ("len", "length", "size", "strlen")),
    ("lowercase", ("lower", "strtolower", "tolower", "tolowercase")),
    ("uppercase", ("strtoupper", "upper", "toupper", "touppercase")),
    ("trim", ("strip", "trim", "trimspace")),
    ("filter", ("filter", "where")),
    ("reduce", ("fold", "reduce")),
    ("map", ("map", "select")),
)
# Kinds of calls.
CALLS = (
    "call", "call_expression", "invocation", "invocation_expression", "method_invocation",
    "function_call_expression", "member_call_expression", "nullsafe_member_call_expression",
    "scoped_call_expression",
)
# What a node's child is in, by the node's canonical name and the child's field; others pass theirs on.
IN_BRANCH = {"condition": "condition", "alternative": "alternative"}

ROLE = {field: role for role, fields in ROLES for field in fields}
OPERATION = {word: family for family, words in OPERATIONS for word in words}


def _map(groups, prefix: str = "") -> Column:
    return F.create_map(*[F.lit(x) for name, keys in groups for key in keys for x in (key, prefix + name)])


def canonical_named(kind: Column, text: Column, vocabulary: Mapping[str, str] | None = None) -> Column:
    """Canonical name of a named node, null for a transparent one. The order of the tests decides.

    Transparent containers come first, then transfers of control by their first word, the vocabulary, keywords, literals
    of SQL, and the suffix rules.
    """
    extended = {k: name for name, kinds in CANONICAL for k in kinds} | dict(vocabulary or {})
    known = F.element_at(_map([(v, (k,)) for k, v in extended.items()]), kind)
    word = F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1))
    transfer = F.when(
        word.isin("break", "continue", "fallthrough", "return", "throw"), F.concat(F.lit("flow:"), word)
    ).otherwise("statement:control-transfer")
    low = F.lower(F.trim(text))
    scalar = (
        F.when((low == "?") | low.rlike(r"^sqlc\.n?arg\(.*\S.*\)$"), "parameter")
        .when(low.isin("true", "false"), "literal:boolean").when(low == "null", "literal:null")
        .when(low.rlike("""^['"]|^[eu].*'|^\\$.*\\$"""), "literal:string")
        .when(low.rlike(r"^[0-9+\-.]"), "literal:number").otherwise("literal:scalar")
    )
    endings = "_(statement|expression|declaration|literal)$"
    suffix = F.regexp_extract(kind, "^(.*)" + endings, 2)
    none = F.lit(None).cast("string")
    return (
        F.when(kind.isin(*TRANSPARENT) | kind.startswith("opt_"), none)
        .when(kind.isin("control_transfer_statement", "flow_control_statement"), transfer)
        .when(known.isNotNull(), known).when(kind == "literal", scalar)
        .when(kind.startswith("keyword_") | kind.startswith("kw_"), none)
        .when(suffix != "", F.concat_ws(":", suffix, F.regexp_replace(kind, endings, "")))
        .otherwise(F.concat(F.lit("syntax:"), kind))
    )


def canonical_operator(kind: Column) -> Column:
    return F.element_at(_map(OPERATORS, "operator:"), kind)


def coarse_class(c: Column) -> Column:
    return (
        F.when(c == "function", "function").when(c.startswith("parameter"), "parameter")
        .when(c.isin("block", "arguments", "binding", "collection"), c)
        .when(c.isin("symbol", "symbol:self") | c.startswith("literal:"), "operand")
        .when(c.startswith("flow:"), "control").when(c.startswith("expression:"), "operation")
        .when(c.startswith("operator:"), "operator").when((c == "query") | c.startswith("query:"), "query")
    )


def rightmost_word(callee: Column) -> Column:
    """The last word of a callee in small letters, empty for none."""
    return F.lower(F.regexp_extract(callee, r"([\p{L}\p{Nd}_]+)[^\p{L}\p{Nd}_]*$", 1))


def semantic_operation(callee: Column) -> Column:
    """Operation family of the right-most word of a callee, null for none."""
    return F.element_at(_map(OPERATIONS), rightmost_word(callee))


def context_of(canonical: str | None, field: str | None, inherited: str) -> str:
    """What a child with this field is in, below a node of this name."""
    if canonical == "flow:if":
        return IN_BRANCH.get(field, "branch")
    if canonical == "flow:loop":
        return "loop-condition" if field == "condition" else "loop-body"
    if canonical in ("flow:switch", "flow:case"):
        return "selection"
    return "deferred" if canonical == "flow:defer" else inherited


def parse_diagnostics(nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(path, total, first) of files with error or missing nodes: how many, and the first ones in document order.

    Nodes may have a column ``has_error`` (of the node or of something below it): of a file that has such nodes only, the
    narrowest one, the first of equal ones, is its one diagnostic.
    """
    at = F.struct("start_byte", "node_id", F.col("kind").alias("node_kind"), "start_line")
    bad = F.col("is_error") | F.col("is_missing")
    first = F.slice(F.array_sort(F.collect_list(F.when(bad, at))), 1, limit)
    counts = [F.count(F.when(bad, 1)).alias("total"), first.alias("first")]
    if "has_error" not in nodes.columns:
        return nodes.where(bad).groupBy("path").agg(*counts)
    narrowest = F.min_by(at, F.struct(F.col("end_byte") - F.col("start_byte"), F.col("node_id")))
    found = nodes.where(bad | F.col("has_error")).groupBy("path").agg(*counts, narrowest.alias("narrowest"))
    none = F.col("total") == 0
    total = F.when(none, 1).otherwise(F.col("total")).cast("long")
    return found.select("path", total.alias("total"), F.when(none, F.array("narrowest")).otherwise(F.col("first")).alias("first"))


def drop_invalid(fragments: DataFrame, nodes: DataFrame, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(fragments without errors and of ``min_tokens`` or more, per file below_floor and skipped counts).

    Both tables carry intervals: ``node_id`` and ``last_id``, the last node of the tree below. A fragment is hurt if an
    error or missing node is in its tree or above it, however wide that node is. Per file one sweep in document order: bad
    nodes up to a place are a running count, and the end of what is below a bad node a running maximum.
    """
    bad = nodes.where("is_error or is_missing").select("path", "node_id", F.col("last_id").alias("reach"))
    ends = F.explode(F.array(
        F.struct(F.col("node_id").alias("at"), F.lit(0).alias("turn"), F.lit(True).alias("opens")),
        F.struct(F.col("last_id").alias("at"), F.lit(2).alias("turn"), F.lit(False).alias("opens")),
    ))
    marks = fragments.select("path", "fragment_id", ends.alias("e")).select("path", "fragment_id", "e.*", F.lit(None).cast("long").alias("reach"))
    marks = marks.unionByName(bad.select(
        "path", F.lit(None).cast(fragments.schema["fragment_id"].dataType).alias("fragment_id"), F.col("node_id").alias("at"),
        F.lit(1).alias("turn"), F.lit(None).cast("boolean").alias("opens"), F.col("reach").cast("long"),
    ))
    before = Window.partitionBy("path").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.withColumn("n", F.count("reach").over(before)).withColumn("below", F.max("reach").over(before) >= F.col("at"))
    swept = swept.where("opens is not null").groupBy("fragment_id").agg(
        (F.max("n") > F.min("n")).alias("inside"), F.bool_or(F.col("opens") & F.coalesce("below", F.lit(False))).alias("under"))
    hurt = swept.select("fragment_id", (F.col("inside") | F.col("under")).alias("hurt"))
    marked = fragments.join(hurt, "fragment_id", "left")
    low = ~F.col("hurt") & (F.col("token_count") < min_tokens)
    counts = marked.groupBy("path").agg(F.count(F.when(low, 1)).alias("below_floor"), F.count(F.when(F.col("hurt"), 1)).alias("skipped"))
    return marked.where(~F.col("hurt") & (F.col("token_count") >= min_tokens)).drop("hurt"), counts
