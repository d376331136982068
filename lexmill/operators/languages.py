"""Languages as sets of column functions, looked up by key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import extraction, lexing, python_lexing, rendering, signatures
from lexmill.functions.exprs import let, words
from lexmill.functions.literals import text_pairs, text_tokens


@dataclass(frozen=True)
class Language:
    """Column functions of one language; hooks that a language lacks are None."""

    lex: Callable[[Column], Column] | None = None  # code -> pairs
    tokenize: Callable[..., Column] | None = None  # code, keep_comments, process_strings -> tokens
    text_pairs: Callable[..., Column] | None = None  # code, keep_comments, process_strings -> tokens with their tags
    render: Callable[[Column], Column] | None = None  # pairs -> code
    detokenize: Callable[[Column], Column] | None = None  # tokens -> code
    functions: Callable[..., Column] | None = None  # tokens, arguments -> functions
    function_name: Callable[[Column], Column] | None = None  # tokens -> name
    arguments: Callable[[Column], Column] | None = None  # text -> (type, name) pairs
    code_functions: Callable[..., Column] | None = None  # code, arguments -> functions, of one shape for all languages
    code_layout: Callable[[Column], Column] | None = None  # code -> code, laid out again from its tokens


LANGUAGES: dict[str, Language] = {}


def register(key: str, language: Language) -> None:
    """Add or replace a language."""
    if not key or key != key.lower():
        raise ValueError("a language key is a lower-case word")
    LANGUAGES[key] = language


def language(key: str) -> Language:
    if key not in LANGUAGES:
        raise ValueError(f"unknown language {key!r}; known: {sorted(LANGUAGES)}")
    return LANGUAGES[key]


def _cfamily_tokenize(key: str, lex: Callable[[Column], Column]) -> Callable[..., Column]:
    def tokenize(code: Column, keep_comments: bool = False, process_strings: bool = True) -> Column:
        return let(lex(code), lambda p: text_tokens(p, key, keep_comments, process_strings))

    return tokenize


def _cfamily_pairs(key: str, lex: Callable[[Column], Column]) -> Callable[..., Column]:
    def pairs(code: Column, keep_comments: bool = False, process_strings: bool = True) -> Column:
        return let(lex(code), lambda p: text_pairs(p, key, keep_comments, process_strings))

    return pairs


def _cfamily_layout(key: str, lex: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def layout(code: Column) -> Column:
        return let(_cfamily_pairs(key, lex)(code, True), lambda pairs: rendering.render_pairs(pairs, key))

    return layout


def _python_lex(code: Column) -> Column:
    """Python tokens with the token itself as tag of layout, and a coarse tag of the rest."""

    def tag(t: Column) -> Column:
        return (
            F.when(t.isin("NEW_LINE", "INDENT", "DEDENT"), t)
            .when(t.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.lit("identifier"))
            .when(t.rlike(r"^\.?[0-9]"), F.lit("number_literal"))
            .when(t.rlike(r"(?s)^[A-Za-z]{0,2} ?[\"'].+"), F.lit("string"))
            .otherwise(t)
        )

    return F.transform(
        python_lexing.lex_python(code),
        lambda t: F.struct(t.alias("token"), tag(t).alias("tag")),
    )


register(
    "cpp",
    Language(
        lex=lexing.lex_cpp,
        tokenize=_cfamily_tokenize("cpp", lexing.lex_cpp),
        text_pairs=_cfamily_pairs("cpp", lexing.lex_cpp),
        render=lambda pairs: rendering.render_pairs(pairs, "cpp"),
        detokenize=lambda tokens: rendering.render_cfamily(tokens, "cpp"),
        functions=lambda tokens, arguments=True: extraction.functions_of("cpp", tokens, arguments),
        function_name=signatures.cfamily_function_name,
        arguments=signatures.extract_arguments,
        code_functions=extraction.cpp_functions,
        code_layout=_cfamily_layout("cpp", lexing.lex_cpp),
    ),
)
register(
    "java",
    Language(
        lex=lexing.lex_java,
        tokenize=_cfamily_tokenize("java", lexing.lex_java),
        text_pairs=_cfamily_pairs("java", lexing.lex_java),
        render=lambda pairs: rendering.render_pairs(pairs, "java"),
        detokenize=lambda tokens: rendering.render_cfamily(tokens, "java"),
        functions=lambda tokens, arguments=True: extraction.functions_of(
            "java", words(F.array_join(tokens, " ")), arguments
        ),
        function_name=signatures.cfamily_function_name,
        arguments=signatures.extract_arguments,
        code_functions=lambda code, arguments=True: let(
            _cfamily_pairs("java", lexing.lex_java)(code, True), lambda pairs: extraction.java_pair_functions(pairs, arguments)
        ),
        code_layout=_cfamily_layout("java", lexing.lex_java),
    ),
)
register(
    "python",
    Language(
        lex=_python_lex,
        tokenize=python_lexing.lex_python,
        detokenize=rendering.render_python,
        functions=lambda tokens, arguments=True: extraction.functions_of("python", tokens, arguments),
        function_name=signatures.python_function_name,
        code_functions=lambda code, arguments=True: extraction.python_functions(python_lexing.lex_python(code)),
        code_layout=lambda code: rendering.render_python(python_lexing.lex_python(code)),
    ),
)


def by_language(lang: Column, hook: str, *values: Column | bool) -> Column:
    """What the hook of each row's language gives, in one pass; NULL for a language without it."""
    (key, step), *rest = [(key, getattr(spec, hook)) for key, spec in LANGUAGES.items() if getattr(spec, hook)]
    case = F.when(lang == key, step(*values))
    for key, step in rest:
        case = case.when(lang == key, step(*values))
    return case


def lex_by_language(lang: Column, code: Column) -> Column:
    """Pairs by the language of each row."""
    return by_language(lang, "lex", code)
