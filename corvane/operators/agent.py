"""The agent: triage, answer, and a bounded number of refinements, over a relation of questions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import with_retries
from ..shared import settle
from ..shipping import ship

ANSWERED, ASK = "AUTO_RESOLVER", "PEDIR_INFO"


def history(conversations: DataFrame, last: int | None = None) -> DataFrame:
    """Turns with all messages before them in ``history``, array<struct<role, text>>; only the ``last`` ones if given, where
    conversations are long."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding if last is None else -last, -1)
    return conversations.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))


# fixed values: what the agent says to the model and, without one, to the user
NO_CONTEXT, LOW_CONFIDENCE, REFINED_BEFORE = "Nenhum contexto relevante foi recuperado.", "Confiança baixa (%.2f).", "Refinamento anterior não retornou resposta satisfatória."
NO_REASON, NO_OPTIONS = "Confiança insuficiente para responder com segurança.", "- (sem opcoes adicionais encontradas)"
ASK_MORE = "Não consegui entender completamente sua pergunta. Poderia fornecer mais detalhes?"


def diagnostic(context_found: Column, confidence: Column, attempts: Column) -> Column:
    """Why an answer falls short, one reason a line."""
    c = F.coalesce(confidence, F.lit(0.0))
    told = F.concat_ws(
        "\n", F.when(~F.coalesce(context_found, F.lit(False)), NO_CONTEXT), F.when(c > 0, F.format_string(LOW_CONFIDENCE, c)), F.when(F.coalesce(attempts, F.lit(0)) > 0, REFINED_BEFORE),
    )
    return F.when(told != "", told).otherwise(F.lit(NO_REASON))


def options_text(options: Column, previews: Column | None = None) -> Column:
    """Options that aren't empty as a list; without any the citations' previews; without those a remark."""
    listed = lambda xs: F.nullif(F.array_join(F.transform(F.filter(xs, lambda o: F.coalesce(o, F.lit("")) != ""), lambda o: F.concat(F.lit("- "), o)), "\n"), F.lit(""))
    return F.coalesce(listed(options), *([listed(previews)] if previews is not None else []), F.lit(NO_OPTIONS))


Model = Callable[[str, str], tuple]


def ask_model(df: DataFrame, model: Model | None, system: str, prompt: Column, out: str) -> DataFrame:
    """``df`` with the model's trimmed text for a prompt, null where it says nothing; Arrow batches, retried calls."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    ship(df.sparkSession)
    call = with_retries(model)

    @F.pandas_udf("string")
    def told(prompts: pd.Series) -> pd.Series:
        return pd.Series([(call(system, p)[0] or "").strip() or None for p in prompts], dtype=object)

    return df.withColumn(out, told(prompt))


def condense(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """``turns`` (question, and ``history`` of :func:`history`) with ``standalone``: the question made whole by the model
    where messages came before it, else the question itself."""
    lines = F.transform("history", lambda m: F.concat(F.when(m["role"] == "user", "Usuário: ").otherwise("IA: "), m["text"]))
    prompt = F.concat(F.lit("HISTÓRICO DA CONVERSA:\n"), F.array_join(lines, "\n"), F.lit("\n\nÚLTIMA PERGUNTA: "), F.col("question"), F.lit("\n\nPERGUNTA AUTÔNOMA:"))
    told = ask_model(turns, model, "Reformule a pergunta para que seja completa sem o histórico.", prompt, "_told")
    return told.withColumn("standalone", F.when(F.size("history") > 0, F.coalesce("_told", "question")).otherwise(F.col("question"))).drop("_told")


def refine_with(model: Model | None, attempts: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A ``refine`` function for :func:`run`: the model words a new query from the question, the last query, the answer and
    the reasons why it fell short. Without a model nothing is refined."""

    def refine(short: DataFrame) -> DataFrame:
        why = diagnostic(F.col("context_found"), F.col("confidence"), F.lit(attempts))
        part = lambda label, c: F.concat(F.lit(label), F.trim(F.coalesce(c, F.lit(""))))
        prompt = F.concat_ws("\n", part("Pergunta original: ", F.col("question")), part("Consulta anterior: ", F.col("asked")), part("Resposta obtida: ", F.coalesce("answer", F.lit("Sem resposta relevante."))), part("Diagnóstico: ", why))
        return ask_model(short, model, "Gere uma consulta curta e precisa, orientada à busca documental.", prompt, "refined").select("query_id", "refined")

    return refine


def ask_for_more(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """``rows`` (question, options, previews) with ``answer``: the model's request for what is missing, or a fixed one."""
    prompt = F.concat_ws("\n", F.lit("Pergunta:"), F.col("question"), F.lit("Opções:"), options_text(F.col("options"), F.col("previews")))
    return ask_model(rows, model, "Peça as informações que faltam a uma pergunta vaga.", prompt, "_told").withColumn("answer", F.coalesce("_told", F.lit(ASK_MORE))).drop("_told")


def run(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame], max_refine: int = 2, min_confidence: float | None = None, default_confidence: float = 0.55) -> DataFrame:
    """One row a question: answer, context_found, confidence, action, refine_attempts, refine_success, query_hash.

    ``answer``: (query_id, question) -> those and answer, context_found, confidence. ``refine``: rows that fell short
    -> (query_id, refined). Rows leave as soon as they are good enough; a refinement that says the same ends a row's
    rounds. There are at most ``max_refine`` rounds, each a plan over the rows that are left.
    """
    bar = min_confidence or default_confidence
    first = questions.select("query_id", "question").withColumn("t", T.triage(F.col("question")))
    asked = first.filter(F.col("t.action") != "answer").select("query_id", "question", F.col("t.message").alias("answer"), F.lit(False).alias("context_found"), F.lit(0.0).alias("confidence"), F.lit(0).alias("refine_attempts"), F.lit(ASK).alias("action"))
    left, done = first.filter(F.col("t.action") == "answer").select("query_id", "question", F.col("question").alias("asked")), [asked]
    good = F.col("context_found") & (F.col("confidence") >= bar)
    for attempt in range(max(0, max_refine) + 1):
        told = answer(left.select("query_id", F.col("asked").alias("question"))).select("query_id", "answer", "context_found", "confidence")
        told = settle(left.join(told, "query_id", "left").fillna({"context_found": False, "confidence": 0.0}), "agent-round")
        row = lambda df, n, action: df.select("query_id", "question", "answer", "context_found", "confidence", F.lit(n).alias("refine_attempts"), F.lit(action).alias("action"))
        done.append(row(told.filter(good), attempt, ANSWERED))
        short = told.filter(~good)
        if attempt == max_refine:
            done.append(row(short, attempt, ASK))
            break
        new = short.join(refine(short).select("query_id", "refined"), "query_id", "left")
        other = F.coalesce(F.lower(F.trim("refined")), F.lit("")) != F.lower(F.trim("asked"))
        usable = (F.coalesce(F.trim("refined"), F.lit("")) != "") & other
        done.append(row(new.filter(~usable), attempt + 1, ASK))
        left = new.filter(usable).select("query_id", "question", F.col("refined").alias("asked"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("refine_success", (F.col("action") == ANSWERED) & (F.col("refine_attempts") > 0)).withColumn("query_hash", T.short_hash(F.col("question")))
