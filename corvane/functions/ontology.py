"""The domain dictionary as small relations; ``ord`` keeps the file's order, as the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold, fold_text, let


class Ontology:
    """departments {slug: label}, aliases {name: [..]}, synonyms {key: [..]}, expansions {key: [..]}, boosts {slug: factor}."""

    def __init__(self, departments=None, aliases=None, synonyms=None, expansions=None, boosts=None):
        self.departments: dict[str, str] = dict(departments or {})
        self.aliases: dict[str, list[str]] = {k: list(v or []) for k, v in (aliases or {}).items()}
        self.synonyms = {fold_text(k): list(v or []) for k, v in (synonyms or {}).items()}
        self.expansions = {fold_text(k): list(v or []) for k, v in (expansions or {}).items()}
        self.boosts = {fold_text(k): float(v) for k, v in (boosts or {}).items()}

    @classmethod
    def load(cls, path: str) -> Ontology:
        """From a YAML file; a file that is missing or malformed gives an empty dictionary."""
        import yaml

        try:
            with open(path, encoding="utf-8") as f:
                raw = yaml.safe_load(f) or {}
        except (OSError, yaml.YAMLError):
            raw = {}
        return cls(raw.get("departments"), raw.get("aliases"), raw.get("synonyms"), raw.get("mq_expansions"), (raw.get("boosts") or {}).get("department"))

    def tokens(self) -> list[tuple[str, str, str]]:
        """(token, slug, label): each department by its folded slug and label."""
        out: dict[str, tuple[str, str]] = {}
        for slug, label in self.departments.items():
            for token in (fold_text(slug), fold_text(label)):
                if token:
                    out.setdefault(token, (slug, label))
        return [(t, s, n) for t, (s, n) in out.items()]

    def first_match(self, text: Column, whole_word: bool = False) -> Column:
        """struct<label, slug> of the first department whose token is in ``text``, as a chain of cases: no join, no
        shuffle. By default a token may stand inside a word; ``whole_word`` asks for word bounds."""
        out = None
        for token, slug, label in self.tokens():
            hit = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" ")).contains(f" {token} ") if whole_word else text.contains(token)
            value = F.struct(F.lit(label).alias("label"), F.lit(slug).alias("slug"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return F.lit(None).cast("struct<label:string,slug:string>") if out is None else out

    def question_slugs(self, question: Column) -> Column:
        """Distinct slugs of the departments that a question names."""
        q = fold(question)
        found = [F.when(q.contains(t), F.lit(s)) for t, s, _ in self.tokens()]
        return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def tag_entities(docs: DataFrame, ontology: Ontology, people: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``entities``, array<struct<label, phrase>>: departments, synonyms and people found as whole words
    in the folded text, in the dictionary's order."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(F.col(text)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    terms = [("DEPARTAMENTO", t) for t, _, _ in ontology.tokens()]
    terms += [("SINONIMO", fold_text(x)) for k, v in ontology.synonyms.items() for x in [k, *v]]
    terms += [("PESSOA", fold_text(p)) for p in people or {}]
    told = [(kind, p) for kind, p in dict.fromkeys(terms) if p]

    def hits(x: Column) -> Column:
        return F.array_compact(F.array(*[F.when(x.contains(f" {p} "), F.struct(F.lit(kind).alias("label"), F.lit(p).alias("phrase"))) for kind, p in told]))

    # a text is folded and padded once, not again for each phrase
    return docs.withColumn("entities", let(padded, hits) if told else F.array().cast("array<struct<label:string,phrase:string>>"))
