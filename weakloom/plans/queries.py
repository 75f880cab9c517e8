"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.functions import lexicons, loss, vectors
from weakloom.functions import text as tx
from weakloom.functions import tokens as tk
from weakloom.operators import end_model as em
from weakloom.operators import entity_links as el
from weakloom.operators import evaluation as ev
from weakloom.operators import features as ft
from weakloom.operators import hmm
from weakloom.operators import label_model as lm
from weakloom.operators import labeling as lb
from weakloom.operators import lf_stats, retrieval, stemming
from weakloom.operators import phrase_spans as ps
from weakloom.operators import rule_structure as rs
from weakloom.operators import search
from weakloom.operators import sentence_rules as sr
from weakloom.operators import sentence_vectors as sv
from weakloom.operators import slices as sl
from weakloom.operators import structuring as st
from weakloom.operators import synonyms as sy
from weakloom.operators import topics as tp
from weakloom.plans import corpus, training
from weakloom.plans import labeling as plan
from weakloom.plans import standins as sd
from weakloom.session import durable, fresh_path
from weakloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

RULES = lb.default_rules()
N_RULES = len(RULES)
EXTRA_PATTERN = lb.Rule("phrase_pattern", "pattern", lb.POSITIVE, regex=r"(the|and) [a-z]*tion[ ,.]")


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _digits(votes: str = "votes") -> Column:
    return F.array_join(F.col(votes).cast("array<string>"), "").alias("votes")


def _r(column, name: str) -> Column:
    return F.round(column, 6).alias(name)


# --- sources and sinks --------------------------------------------------------------------

@query
def inputs_by_suffix(spark, sf_dir):
    return sd.table(spark, sf_dir, "pages").where(files.has_suffix(F.col("url"), ".html")).select("page_id", "url")


@query
def output_paths(spark, sf_dir):
    path = F.concat(F.lit("../data/raw/"), "source", F.lit("/raw-"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return sd.table(spark, sf_dir, "documents").select("doc_id", tx.replace_in_path(path).alias("path"))


@query
def matrix_scan(spark, sf_dir):
    return _matrix_digest(sd.table(spark, sf_dir, "embeddings"))


def _matrix_digest(df):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select("vec_id", F.size("embedding").alias("width"), _r(total, "total"))


@query
def csv_round_trip(spark, sf_dir):
    docs = sd.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = fresh_path(spark, "csv")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, docs.schema)


@query
def matrix_round_trip(spark, sf_dir):
    path = fresh_path(spark, "matrix")
    files.write_matrix(sd.table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding")
    return _matrix_digest(files.read_matrix(spark, path))


@query
def text_sink_round_trip(spark, sf_dir):
    path = fresh_path(spark, "texts")
    files.write_texts(corpus.prepare_corpus(_conversations(spark, sf_dir)), path, folders=16)
    return files.read_text_folders(spark, path).select(F.col("doc").cast("long").alias("doc_id"), "text")


# --- text structuring ---------------------------------------------------------------------

def _conversations(spark, sf_dir):
    """Conversations as documents, turns as pages."""
    return sd.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")


def _documents(spark, sf_dir):
    return sd.documents(spark, sf_dir, "doc_id", "text")


def _titled(spark, sf_dir):
    return _documents(spark, sf_dir).withColumn("path", sd.title_path(F.col("text")))


@query
def split_lines(spark, sf_dir):
    return st.page_lines(_conversations(spark, sf_dir))


@query
def numbered_lines(spark, sf_dir):
    return st.numbered_lines(_conversations(spark, sf_dir))


@query
def lines_without_titles(spark, sf_dir):
    return st.lines_without_titles(_conversations(spark, sf_dir))


@query
def title_counts(spark, sf_dir):
    return st.title_counts(_conversations(spark, sf_dir))


@query
def page_paragraphs(spark, sf_dir):
    return st.page_paragraphs(_conversations(spark, sf_dir))


@query
def clean_page_paragraphs(spark, sf_dir):
    return corpus.prepare_corpus(_conversations(spark, sf_dir))


@query
def document_paragraphs(spark, sf_dir):
    return st.document_paragraphs(_documents(spark, sf_dir), cleaned=False)


@query
def clean_document_paragraphs(spark, sf_dir):
    return corpus.prepare_corpus(_titled(spark, sf_dir), page=None, path="path")


@query
def collapsed_blanks(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.collapse_blanks(F.col("text")).alias("text"))


@query
def title_words(spark, sf_dir):
    return sd.table(spark, sf_dir, "pages").select("page_id", F.posexplode(tx.title_words(F.col("url"))).alias("at", "word"))


@query
def ngram_windows(spark, sf_dir):
    grams = _documents(spark, sf_dir).select("doc_id", tk.tokens(F.col("text")).alias("_t")).select(
        "doc_id", tx.windows(F.col("_t"), 3).alias("_g"))
    return grams.select("doc_id", F.size("_g").alias("n_windows"), F.size(F.array_distinct("_g")).alias("n_distinct"),
                        F.get("_g", F.lit(0)).alias("first_window"), F.get("_g", F.size("_g") - 1).alias("last_window"))


@query
def title_ngrams(spark, sf_dir):
    words = _titled(spark, sf_dir).select("doc_id", tx.title_words(F.col("path")).alias("_w"))
    return words.select("doc_id", F.posexplode(tx.title_ngrams(F.col("_w"))).alias("at", "gram"))


@query
def removed_headers(spark, sf_dir):
    words = _titled(spark, sf_dir).select("doc_id", "text", tx.title_words(F.col("path")).alias("_w"))
    return st.with_title_grams(words, "_w").select(
        "doc_id", tx.remove_headers(F.col("text"), F.col("_grams"), F.col("_short")).alias("text"))


@query
def stripped_brackets(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.strip_brackets(F.col("text")).alias("text"))


@query
def lowered_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))


@query
def stripped_punctuation(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.strip_punctuation(F.col("text")).alias("text"))


# --- retrieval and table assembly -----------------------------------------------------------

def _scored(spark, sf_dir):
    return retrieval.score(sd.table(spark, sf_dir, "embeddings"), "embedding", sd.query_vector(spark, sf_dir)).select(
        "vec_id", "label", "results")


@query
def similarity_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", _r("results", "results"))


@query
def similarity_filter(spark, sf_dir):
    return retrieval.above(_scored(spark, sf_dir), sd.THRESHOLD).select("vec_id", _r("results", "results"))


@query
def similarity_filter_default(spark, sf_dir):
    return retrieval.above(_scored(spark, sf_dir)).select("vec_id", _r("results", "results"))


@query
def similarity_band(spark, sf_dir):
    return retrieval.above(_scored(spark, sf_dir), sd.THRESHOLD, sd.THRESHOLD + 0.05).select("vec_id", _r("results", "results"))


@query
def ranked_results(spark, sf_dir):
    hits = retrieval.above(_scored(spark, sf_dir), sd.THRESHOLD)
    return retrieval.ranked(hits, "label", tie="vec_id").select("label", "vec_id", _r("results", "results"))


@query
def best_per_label(spark, sf_dir):
    return retrieval.best_per_name(_scored(spark, sf_dir), "label", 5, tie="vec_id").select(
        "label", "vec_id", "rank", _r("results", "results"))


def _asked(spark, sf_dir):
    """All embeddings, and those with an id divisible by 100 as queries."""
    rows = sd.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows, rows.where("vec_id % 100 = 0")


def _ranked_neighbours(found):
    return found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "rank", _r("score", "score"))


@query
def query_neighbours(spark, sf_dir):
    """The ten nearest of all embeddings for many query vectors at once."""
    return _ranked_neighbours(search.nearest(*_asked(spark, sf_dir), 10, "vec_id", "embedding"))


def _indexed(spark, sf_dir):
    rows, asked = _asked(spark, sf_dir)
    index = search.build_index(rows, "vec_id", "embedding")
    probes = search.probes_needed(index, asked, 10, "vec_id", "embedding")
    return rows, asked, search.search_index(index, asked, 10, "vec_id", "embedding", probes)


@query
def indexed_neighbours(spark, sf_dir):
    """The same through the index of cells, with as many probes as the audited queries need."""
    return _ranked_neighbours(_indexed(spark, sf_dir)[2])


@query
def index_recall(spark, sf_dir):
    """Whether the index finds nine of ten true neighbours of all queries."""
    rows, asked, found = _indexed(spark, sf_dir)
    exact = search.nearest(rows, asked, 10, "vec_id", "embedding")
    recall = search.recall_of(durable(found), exact)
    return asked.agg(F.count(F.lit(1)).alias("n_queries")).withColumn("enough", F.lit(recall >= 0.9))


@query
def manual_labels(spark, sf_dir):
    return retrieval.attach_labels(_documents(spark, sf_dir).select("doc_id"), sd.table(spark, sf_dir, "labels"), "doc_id")


@query
def table_shape(spark, sf_dir):
    return retrieval.shape(sd.table(spark, sf_dir, "documents"))


@query
def table_head(spark, sf_dir):
    return retrieval.head(sd.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), 5, "doc_id")


@query
def default_class(spark, sf_dir):
    return sd.gold_documents(spark, sf_dir).select("doc_id", retrieval.default_class(F.col("class")).alias("class"))


@query
def letter_codes(spark, sf_dir):
    coded = sd.gold_documents(spark, sf_dir).select("doc_id", retrieval.letter_of_class(F.col("class")).alias("letter"))
    return coded.select("doc_id", "letter", retrieval.class_of_letter(F.col("letter")).alias("class"))


@query
def corrected_labels(spark, sf_dir):
    corrections = sd.table(spark, sf_dir, "labels").where("toxic = 1 and quality = 1").select("doc_id", F.lit(1).alias("class"))
    return retrieval.correct_labels(sd.gold_documents(spark, sf_dir).select("doc_id", "class"), corrections, "doc_id", "class")


COUNTRIES = {"de": "Germany", "en": "England", "es": "Spain", "fr": "France"}


def _countries(spark, sf_dir):
    return retrieval.tag_countries(sd.documents(spark, sf_dir, "doc_id", "lang", "text"), "lang", COUNTRIES)


def _united(docs):
    """The same rows as ``tag_countries``, from one table per named country and one of all others."""
    tables = {name: docs.where(F.col("lang") == lang).drop("lang") for lang, name in COUNTRIES.items()}
    others = docs.where(~F.coalesce(F.col("lang").isin(*COUNTRIES), F.lit(False)))
    return retrieval.union_countries(tables, "doc_id", retrieval.tag_countries(others, "lang", {"": ""}))


@query
def union_countries(spark, sf_dir):
    docs = sd.documents(spark, sf_dir, "doc_id", "lang", "text").select("doc_id", "lang", F.length("text").alias("n_chars"))
    return _united(docs).select("country", "doc_id", "n_chars")


@query
def positional_join(spark, sf_dir):
    left = sd.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("vec_label"))
    right = sd.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return retrieval.positional_join(left, right, "vec_id", "doc_id")


@query
def row_lookup(spark, sf_dir):
    return retrieval.rows_at(_countries(spark, sf_dir), "doc_id", 35, major=["country"])


@query
def row_preview(spark, sf_dir):
    # Two keys are picked and meet their labels before any text is read.
    docs = sd.table(spark, sf_dir, "documents").select("doc_id", "text")
    picked = retrieval.keys_at(docs, "doc_id", 50, 51).join(sd.gold_labels(spark, sf_dir), "doc_id", "left")
    return docs.join(F.broadcast(picked), "doc_id").select("doc_id", "class", "text", "position")


# --- labeling rules -------------------------------------------------------------------------

def _plain(groups=sd.PHRASES):
    return lb.plain_lexicon(groups)


def _voted(spark, sf_dir, groups=sd.PHRASES):
    return lb.vote_matrix(_documents(spark, sf_dir), "text", RULES, _plain(groups)).drop("text")


@query
def tokenized(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(tk.tokens(F.col("text")), " ").alias("tokens"))


@query
def stemmed_vocabulary(spark, sf_dir):
    return stemming.stemmed_vocabulary(_documents(spark, sf_dir), "text")


@query
def lexicon_forms(spark, sf_dir):
    stems = stemming.stem_table(spark, stemming.lexicon_words(sd.PHRASES))
    return stemming.surface_forms(_documents(spark, sf_dir), "text", stems)


@query
def phrase_positions(spark, sf_dir):
    """Position of every phrase of the ``budgets`` and ``encouraging`` groups, where it occurs."""
    wanted = [(g, p) for g in ("budgets", "encouraging") for p in sd.PHRASES[g]]
    frame = lb.with_occurrences(_documents(spark, sf_dir), "text", _plain()).drop("text")
    frame = lb.with_phrase_arrays(frame, max(len(tk.phrase_words(p)) for _, p in wanted))
    found = F.array(*[F.struct(F.lit(g).alias("group_name"), F.lit(p).alias("phrase"),
                               tk.first_at("_at", f"_g{len(tk.phrase_words(p))}", p).alias("position")) for g, p in wanted])
    return frame.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*").where("position is not null")


@query
def pair_distances(spark, sf_dir):
    frame = lb.with_occurrences(_documents(spark, sf_dir), "text", _plain()).drop("text")
    return lb.with_distances(frame, RULES, _plain())


@query
def near_votes(spark, sf_dir):
    rules = [r for r in RULES if r.kind == "near"]
    voted = lb.vote_matrix(_documents(spark, sf_dir), "text", rules, _plain())
    return lb.long_votes(voted, "doc_id", rules)


@query
def contains_votes(spark, sf_dir):
    rules = [r for r in RULES if r.kind == "contains"] + [lb.encourage_rule()]
    voted = lb.vote_matrix(_documents(spark, sf_dir), "text", rules, _plain())
    return lb.long_votes(voted, "doc_id", rules)


@query
def tally_votes(spark, sf_dir):
    voted = lb.long_votes(_voted(spark, sf_dir), "doc_id", RULES)
    return voted.where(F.col("rule").isin([r.name for r in RULES if r.kind == "tally"])).select("doc_id", "rule", "vote")


@query
def pattern_votes(spark, sf_dir):
    rules = [EXTRA_PATTERN, lb.reduce_words_rule()]
    voted = lb.vote_matrix(_documents(spark, sf_dir), "text", rules, _plain())
    return lb.long_votes(voted, "doc_id", rules)


@query
def custom_votes(spark, sf_dir):
    """A user-defined rule as a Column builder beside a built-in one."""
    rules = [lb.Rule("long_text", "custom", lb.NEGATIVE, build=lambda t: F.when(F.length(t) > 500, 2).otherwise(0)),
             lb.tally("quiet", 1)]
    voted = lb.vote_matrix(_documents(spark, sf_dir), "text", rules, _plain())
    return lb.long_votes(voted, "doc_id", rules)


@query
def vote_matrix(spark, sf_dir):
    return _voted(spark, sf_dir).select("doc_id", _digits())


@query
def vote_matrix_policy_phrases(spark, sf_dir):
    return _voted(spark, sf_dir, lexicons.POLICY).select("doc_id", _digits())


@query
def vote_matrix_stemmed(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    lexicon = lb.stemmed_lexicon(spark, sd.PHRASES)
    return lb.vote_matrix(docs, "text", RULES, lexicon).select("doc_id", _digits())


@query
def vote_matrix_stemmed_by_join(spark, sf_dir):
    voted = lb.stemmed_votes_by_join(_documents(spark, sf_dir), "doc_id", "text", RULES, sd.PHRASES)
    return voted.select("doc_id", _digits())


@query
def vote_matrix_policy_stemmed(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    lexicon = lb.stemmed_lexicon(spark, lexicons.POLICY)
    return lb.vote_matrix(docs, "text", RULES, lexicon).select("doc_id", _digits())


@query
def paragraph_votes(spark, sf_dir):
    """Votes on the clean paragraphs of all conversations."""
    paragraphs = corpus.prepare_corpus(_conversations(spark, sf_dir))
    voted = lb.vote_matrix(paragraphs, "text", RULES, _plain())
    return voted.select("doc_id", "para_id", _digits())


# --- statistics, label model, evaluation ------------------------------------------------------

def _gold_votes(spark, sf_dir):
    """Votes are made on the scan; only they, not the texts, meet the labels."""
    return _voted(spark, sf_dir).join(sd.gold_labels(spark, sf_dir), "doc_id", "left")


def _patterns(spark, sf_dir, *by):
    voted = _gold_votes(spark, sf_dir) if by else _voted(spark, sf_dir)
    return lf_stats.vote_patterns(voted, *by)


def _coverage_columns():
    return [F.array_join(F.col("polarity").cast("array<string>"), ",").alias("polarity"),
            _r("coverage", "coverage"), _r("overlaps", "overlaps"), _r("conflicts", "conflicts")]


@query
def rule_coverage(spark, sf_dir):
    """Flagship: the vote matrix and the coverage of every rule."""
    return lf_stats.lf_summary(_patterns(spark, sf_dir), RULES).select("rule_no", "rule", _r("coverage", "coverage"))


@query
def lf_summary(spark, sf_dir):
    return lf_stats.lf_summary(_patterns(spark, sf_dir), RULES).select("rule_no", "rule", *_coverage_columns())


@query
def lf_summary_gold(spark, sf_dir):
    voted = _gold_votes(spark, sf_dir).withColumn("class", retrieval.default_class(F.col("class")))
    patterns = lf_stats.vote_patterns(voted, "class")
    return lf_stats.lf_summary(patterns, RULES, "class").select(
        "rule_no", "rule", *_coverage_columns(), "correct", "incorrect", _r("accuracy", "accuracy"))


@query
def label_coverage(spark, sf_dir):
    return lf_stats.label_coverage(_patterns(spark, sf_dir)).select(_r("coverage", "coverage"))


@query
def vote_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir).select(_digits(), "n")


@query
def majority_vote(spark, sf_dir):
    return _voted(spark, sf_dir).select("doc_id", lf_stats.majority_vote(F.col("votes")).alias("predicted"))


@query
def other_table_votes(spark, sf_dir):
    """A stemmed lexicon made from the phrase lists alone labels a table that no fit has seen."""
    turns = sd.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return lb.vote_matrix(turns, "text", RULES, lb.stemmed_lexicon(spark, sd.PHRASES)).select("conv_id", "turn", _digits())


@query
def class_balance(spark, sf_dir):
    return lf_stats.class_balance(sd.gold_documents(spark, sf_dir), "class").select("class", "n", _r("share", "share"))


@query
def vote_moments(spark, sf_dir):
    moments = lm.vote_moments(durable(_patterns(spark, sf_dir)))
    return moments.select("rule_i", "vote_i", "rule_j", "vote_j", _r("p", "p"))


@query
def vote_conditionals(spark, sf_dir):
    return lm.vote_conditionals(durable(_patterns(spark, sf_dir, "class")), "class", N_RULES).select(
        "rule_no", "vote", "class", _r("p", "p"))


def _supervised(spark, sf_dir):
    """Gold votes with posterior and prediction of the closed-form model."""
    voted = durable(_gold_votes(spark, sf_dir))
    model = lm.supervised_model(lf_stats.vote_patterns(voted, "class"), "class", N_RULES)
    scored = model.with_posterior(voted)
    return scored.withColumn("predicted", model.predict(F.col("proba")))


def _proba_columns():
    return [F.round(F.get("proba", F.lit(i)), 6).alias(n) for i, n in enumerate(("p_neutral", "p_negative", "p_positive"))]


@query
def posteriors(spark, sf_dir):
    return _supervised(spark, sf_dir).select("doc_id", *_proba_columns())


@query
def predicted_classes(spark, sf_dir):
    return _supervised(spark, sf_dir).select("doc_id", "predicted")


@query
def label_model_posteriors(spark, sf_dir):
    """Label model fitted on vote moments, without single gold labels."""
    voted = durable(_gold_votes(spark, sf_dir))
    patterns = durable(lf_stats.vote_patterns(voted, "class"))
    model = lm.fit_label_model(patterns, lm.balance_of(patterns, "class"), N_RULES)
    scored = model.with_posterior(voted)
    return scored.select("doc_id", *_proba_columns(), model.predict(F.col("proba")).alias("predicted"))


# The narrow and the wide form of each distance rule.
NESTED_RULES = [(i, i + 1) for i in range(0, 20, 2)]


@query
def vote_covariance(spark, sf_dir):
    covariances = rs.vote_covariance(durable(_patterns(spark, sf_dir)))
    return covariances.select("rule_i", "vote_i", "rule_j", "vote_j", _r("covariance", "covariance"))


@query
def pair_vote_moments(spark, sf_dir):
    """Shares of rows where a rule votes beside both forms of a distance rule."""
    return rs.pair_vote_moments(durable(_patterns(spark, sf_dir)), NESTED_RULES).select(
        "left", "right", "vote_left", "vote_right", "rule", "vote", _r("p", "p"))


@query
def rule_dependencies(spark, sf_dir):
    """Rules whose votes go together more than the class explains."""
    names = [r.name for r in RULES]
    found = rs.dependencies(durable(_patterns(spark, sf_dir)), N_RULES)
    return spark.createDataFrame([(names[d.left], names[d.right], round(float(d.strength), 4), d.used) for d in found],
                                 "left string, right string, strength double, used boolean")


def _dependent(spark, sf_dir):
    """Gold votes, and the label model that knows which rules depend on each other."""
    voted = durable(_gold_votes(spark, sf_dir))
    patterns = durable(lf_stats.vote_patterns(voted, "class"))
    return voted, rs.fit_dependent_model(patterns, lm.balance_of(patterns, "class"), N_RULES)


@query
def dependent_posteriors(spark, sf_dir):
    voted, model = _dependent(spark, sf_dir)
    scored = model.with_posterior(voted)
    return scored.select("doc_id", *_proba_columns(), model.predict(F.col("proba")).alias("predicted"))


@query
def fitted_shares(spark, sf_dir):
    """Share of each vote, and whether the fitted model gives the same share (to 0.02)."""
    patterns = durable(lf_stats.vote_patterns(_gold_votes(spark, sf_dir), "class"))
    model = lm.fit_label_model(patterns, lm.balance_of(patterns, "class"), N_RULES)
    share = F.sum(F.col("p") * F.get(F.array(*[F.lit(x) for x in model.balance]), F.col("class") - 1))
    fitted = model.weights(spark).groupBy("rule_no", "vote").agg(share.alias("fitted"))
    single = lm.vote_moments(patterns).where("rule_i = rule_j").select(F.col("rule_i").alias("rule_no"), F.col("vote_i").alias("vote"), "p")
    return single.join(fitted, ["rule_no", "vote"]).select("rule_no", "vote", _r("p", "share"), (F.abs(F.col("p") - F.col("fitted")) < 0.02).alias("close"))


@query
def fitted_class_scores(spark, sf_dir):
    """As ``class_scores``, for the label model fitted without gold labels of rows, with and without dependent rules."""
    voted, dependent = _dependent(spark, sf_dir)
    patterns = durable(lf_stats.vote_patterns(voted, "class"))
    plain = lm.fit_label_model(patterns, dependent.balance, N_RULES)
    parts = []
    for name, model in (("independent", plain), ("dependent", dependent)):
        predicted = model.with_posterior(voted).select("class", model.predict(F.col("proba")).alias("predicted"))
        parts.append(ev.class_scores(ev.confusion(predicted, "class", "predicted")).withColumn("model", F.lit(name)))
    scores = parts[0].unionByName(parts[1])
    return scores.select("model", "class", "hits", "wrong", "missed", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"),
                         _r("accuracy", "accuracy"))


@query
def stored_model_posteriors(spark, sf_dir):
    """Posteriors of the closed-form model after it was stored and read back."""
    voted = durable(_gold_votes(spark, sf_dir))
    path = fresh_path(spark, "label-model")
    rs.write_model(spark, lm.supervised_model(lf_stats.vote_patterns(voted, "class"), "class", N_RULES), path)
    return rs.read_model(spark, path).with_posterior(voted).select("doc_id", *_proba_columns())


@query
def noisy_labels(spark, sf_dir):
    """The whole labeling plan in stemmed mode: fit on gold documents, label all countries."""
    lexicon = plan.lexicon_of(spark, sd.PHRASES)
    # The texts are read once and stay in the scan; gold rows and the rows to label are the same documents.
    voted = durable(lb.vote_matrix(_countries(spark, sf_dir), "text", RULES, lexicon).select("country", "doc_id", "votes"))
    labelled = voted.join(sd.gold_labels(spark, sf_dir), "doc_id", "left")
    fitted = plan.fit_votes(labelled.select("class", "votes"), "class", RULES, lexicon)
    return fitted.apply_votes(voted).select("country", "doc_id", _digits(), *_proba_columns(), "predicted")


def _majority(spark, sf_dir):
    return _gold_votes(spark, sf_dir).select("doc_id", "class", lf_stats.majority_vote(F.col("votes")).alias("predicted"))


@query
def confusion_matrix(spark, sf_dir):
    return ev.confusion(_majority(spark, sf_dir), "class", "predicted")


@query
def class_scores(spark, sf_dir):
    scores = ev.class_scores(ev.confusion(_majority(spark, sf_dir), "class", "predicted"))
    return scores.select("class", "hits", "wrong", "missed", _r("precision", "precision"), _r("recall", "recall"),
                         _r("f1", "f1"), _r("accuracy", "accuracy"))


@query
def f1_summary(spark, sf_dir):
    scores = ev.class_scores(ev.confusion(_majority(spark, sf_dir), "class", "predicted"))
    return ev.f1_summary(scores).select(_r("f1_macro", "f1_macro"), _r("f1_weighted", "f1_weighted"))


@query
def label_histogram(spark, sf_dir):
    return ev.label_histogram(_majority(spark, sf_dir), "class", "predicted")


@query
def probability_histogram(spark, sf_dir):
    rounded = _supervised(spark, sf_dir).select(F.transform("proba", lambda p: F.round(p, 6)).alias("proba"))
    return ev.probability_histogram(rounded, "proba")


def _model_predictions(spark, sf_dir):
    return _supervised(spark, sf_dir).select("doc_id", "class", "predicted")


@query
def model_class_scores(spark, sf_dir):
    """As ``class_scores``, for the predictions of the closed-form label model."""
    scores = ev.class_scores(ev.confusion(_model_predictions(spark, sf_dir), "class", "predicted"))
    return scores.select("class", "hits", "wrong", "missed", _r("precision", "precision"), _r("recall", "recall"),
                         _r("f1", "f1"), _r("accuracy", "accuracy"))


@query
def model_label_histogram(spark, sf_dir):
    return ev.label_histogram(_model_predictions(spark, sf_dir), "class", "predicted")


@query
def model_false_negatives(spark, sf_dir):
    return ev.errors(_model_predictions(spark, sf_dir), "class", "predicted", lb.NEGATIVE)


@query
def labeling_errors(spark, sf_dir):
    return ev.errors(_majority(spark, sf_dir), "class", "predicted")


@query
def false_negatives(spark, sf_dir):
    return _wrong_texts(spark, sf_dir, lb.NEGATIVE)


@query
def missed_positives(spark, sf_dir):
    return _wrong_texts(spark, sf_dir, lb.POSITIVE)


def _wrong_texts(spark, sf_dir, gold_class):
    """Wrongly predicted documents of a class, with text: only those predicted otherwise meet the labels of the class."""
    voted = lb.vote_matrix(_documents(spark, sf_dir), "text", RULES, _plain())
    other = voted.select("doc_id", "text", lf_stats.majority_vote(F.col("votes")).alias("predicted")).where(F.col("predicted") != gold_class)
    return other.join(sd.gold_labels(spark, sf_dir).where(F.col("class") == gold_class), "doc_id").select("doc_id", "text", "class", "predicted")


# --- hidden states of paragraphs ---------------------------------------------------------------

def _paragraph_chunks(spark, sf_dir):
    paragraphs = st.document_paragraphs(_documents(spark, sf_dir))
    return hmm.chunked(paragraphs.select("doc_id", "para_id", sd.paragraph_symbol(F.col("text")).alias("symbol")), "doc_id", "para_id", "symbol")


@query
def paragraph_states(spark, sf_dir):
    """Forward-backward over the paragraphs of every document."""
    found = hmm.state_posteriors(_paragraph_chunks(spark, sf_dir), sd.STATES)
    return found.select(F.col("doc").alias("doc_id"), F.col("place").alias("para_id"),
                        *[F.round(F.get("proba", F.lit(i)), 6).alias(f"p_{i}") for i in range(3)])


@query
def state_update(spark, sf_dir):
    """The parameters after one round of training."""
    model = hmm.updated(hmm.expected_counts(_paragraph_chunks(spark, sf_dir), sd.STATES), 0.001)
    rows = [("start", 0, j, p) for j, p in enumerate(model.start)]
    rows += [(name, i, j, p) for name, table in (("step", model.step), ("emit", model.emit)) for i, row in enumerate(table) for j, p in enumerate(row)]
    return spark.createDataFrame(rows, "part string, i int, j int, p double").select("part", "i", "j", _r("p", "p"))


@query
def state_likelihoods(spark, sf_dir):
    """The log-likelihood before each of four rounds of training and after the last."""
    _, found = hmm.fit_states(_paragraph_chunks(spark, sf_dir), sd.STATES, rounds=4)
    return spark.createDataFrame(list(enumerate(found)), "round int, log_likelihood double")


# --- rules as sentences -----------------------------------------------------------------------

@query
def sentence_rule_votes(spark, sf_dir):
    """Votes of the rules written as sentences."""
    rules, _ = sr.parse_all(sd.SENTENCES, sd.PHRASES)
    return lb.long_votes(lb.vote_matrix(_documents(spark, sf_dir), "text", rules, _plain()), "doc_id", rules)


@query
def sentence_rule_report(spark, sf_dir):
    """Which of them are kept: compared with each other, and with the majority of the rules built by hand, in one pass over the text."""
    rules, _ = sr.parse_all(sd.SENTENCES, sd.PHRASES)
    # Two matrices, as the tallies among the first count the rules of their own matrix.
    by_hand = lb.vote_matrix(_documents(spark, sf_dir), "text", RULES, _plain())
    by_hand = by_hand.select("doc_id", "text", lf_stats.majority_vote(F.col("votes")).alias("majority"))
    report = sr.rule_report(lb.vote_matrix(by_hand, "text", rules, _plain()), "doc_id", [r.name for r in rules], "majority")
    return report.select("rule_no", "rule", _r("coverage", "coverage"), _r("agreement", "agreement"), "same_as", "kept")


# --- phrases and slices -------------------------------------------------------------------------

@query
def phrase_spans(spark, sf_dir):
    """All runs of two to four words of the benchmark texts, in all documents."""
    listed = ps.windows_of(sd.table(spark, sf_dir, "benchmark"), "text", (2, 3, 4))
    label = F.concat(F.lit("words_"), F.size(F.split("phrase", " ")).cast("string"))
    found = ps.find_phrases(_documents(spark, sf_dir), "doc_id", "text", listed.withColumn("label", label))
    return found.select("doc_id", "begin", "size", "phrase", "label")


def _mentions(spark, sf_dir):
    """Pairs of words that stand in a benchmark text, as names of that text, and their places in the documents."""
    items = sd.table(spark, sf_dir, "benchmark").select("item_id", tk.tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    aliases = durable(items.select(F.col("item_id").alias("entity"), F.explode(pairs).alias("alias")).distinct())
    listed = aliases.select(F.col("alias").alias("phrase")).distinct().withColumn("label", F.lit("item"))
    spans = ps.find_phrases(_documents(spark, sf_dir), "doc_id", "text", listed)
    return aliases, durable(spans.select(F.col("doc_id").alias("doc"), F.col("phrase").alias("mention")))


@query
def entity_candidates(spark, sf_dir):
    """Benchmark texts with a name similar to one found in a document."""
    aliases, mentions = _mentions(spark, sf_dir)
    return el.candidates(mentions, aliases).select("mention", "entity", _r("score", "score"))


@query
def entity_ranks(spark, sf_dir):
    """Ranks of the benchmark texts after three rounds between documents and texts."""
    aliases, mentions = _mentions(spark, sf_dir)
    graph = el.mention_graph(mentions, durable(el.candidates(mentions, aliases)))
    return el.entity_ranks(graph, 3).select("entity", F.round("rank", 8).alias("rank"))


@query
def entity_links(spark, sf_dir):
    """The benchmark text each name in a document is taken for."""
    aliases, mentions = _mentions(spark, sf_dir)
    found = durable(el.candidates(mentions, aliases))
    return el.link_mentions(mentions, found, el.entity_ranks(el.mention_graph(mentions, found), 3)).select(
        F.col("doc").alias("doc_id"), "mention", "n", "entity", _r("score", "score"))


SLICES = {
    "english": "lang = 'en'", "german": "lang = 'de'", "long": "n_chars >= 2000", "short": "n_chars < 500",
    "many_votes": "size(filter(votes, v -> v > 0)) >= 10", "conflict": "size(array_distinct(filter(votes, v -> v > 0))) > 1",
}


def _sliced(spark, sf_dir):
    """Majority votes with the slices of each document; texts do not leave the scan."""
    docs = sd.documents(spark, sf_dir, "doc_id", "text", "lang", "n_chars")
    voted = lb.vote_matrix(docs, "text", RULES, _plain()).select("doc_id", "lang", "n_chars", "votes")
    marked = sl.with_slices(voted, SLICES).select("doc_id", "slices", lf_stats.majority_vote(F.col("votes")).alias("predicted"))
    return marked.join(sd.gold_labels(spark, sf_dir), "doc_id", "left")


@query
def slice_scores(spark, sf_dir):
    scores = sl.slice_scores(_sliced(spark, sf_dir), "class", "predicted", list(SLICES))
    return scores.select("slice", "class", "hits", "wrong", "missed", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"),
                         _r("accuracy", "accuracy"))


@query
def slice_overlaps(spark, sf_dir):
    return sl.slice_overlaps(_sliced(spark, sf_dir), list(SLICES))


@query
def slice_weights(spark, sf_dir):
    """Training weights of the documents with a class, from the slices in which the majority vote is wrong more often."""
    marked = durable(_sliced(spark, sf_dir).where("class is not null"))
    marked = marked.withColumn("wrong", (F.col("predicted") != F.col("class")).cast("double"))
    residuals = sl.slice_residuals(marked, "wrong", list(SLICES))
    return sl.residual_weights(marked, residuals, len(SLICES)).select("doc_id", _r("weight", "weight"))


@query
def token_weights(spark, sf_dir):
    return sv.token_weights(_documents(spark, sf_dir), "text").select("token", _r("share", "share"), _r("weight", "weight"))


@query
def sentence_vectors(spark, sf_dir):
    """Every document's vector after three rounds towards the shared direction."""
    found = sv.sentence_vectors(_documents(spark, sf_dir), "doc_id", "text", sd.token_vectors(spark, sf_dir), 64, rounds=3)
    return found.select(F.col("key").alias("doc_id"), F.posexplode("vector").alias("at", "value")).select("doc_id", "at", _r("value", "value"))


# --- words used alike --------------------------------------------------------------------------

def _word_vectors(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs, durable(sy.mutual_information(sy.meeting_words(docs, "text", tp.vocabulary(docs, "text", N_TERMS))))


@query
def word_information(spark, sf_dir):
    """How much more often than by chance the most frequent words stand near each other."""
    return _word_vectors(spark, sf_dir)[1].select("a", "b", _r("weight", "weight"))


@query
def word_neighbours(spark, sf_dir):
    found = sy.neighbours(_word_vectors(spark, sf_dir)[1])
    return found.select("word", "neighbour", _r("cosine", "cosine"), "rank")


@query
def augmented_documents(spark, sf_dir):
    """A copy of every document with a fifth of the words that have neighbours replaced."""
    docs, vectors = _word_vectors(spark, sf_dir)
    return sy.augmented(docs, "doc_id", "text", sy.neighbours(vectors))


# --- topics -----------------------------------------------------------------------------------

N_TOPICS, N_TERMS = 4, 300


@query
def topic_vocabulary(spark, sf_dir):
    """The terms in most documents, in order."""
    words = tp.vocabulary(_documents(spark, sf_dir), "text", N_TERMS)
    return spark.createDataFrame(list(enumerate(words)), "place int, term string")


@query
def topic_round(spark, sf_dir):
    """Shares of the terms after one round in which documents take two steps to their mixture."""
    docs = _documents(spark, sf_dir)
    words = tp.vocabulary(docs, "text", N_TERMS)
    model = tp.start_topics(spark, words, N_TOPICS, steps=2)
    sums, _ = tp.term_sums(tp.counted(docs, "doc_id", "text", words), model)
    return tp.next_topics(model, sums).table(spark).select("topic", "term", _r("share", "share"))


@query
def topic_mixtures(spark, sf_dir):
    """Topics of all documents after ten rounds."""
    model, counts, _ = tp.fit_topics(_documents(spark, sf_dir), "doc_id", "text", N_TOPICS, rounds=10, terms=2000)
    return tp.mixtures(counts, model).select(F.col("key").alias("doc_id"), F.posexplode("mixture").alias("topic", "share")).select(
        "doc_id", "topic", _r("share", "share"))


# --- features and end model -------------------------------------------------------------------

@query
def truncated_words(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.first_words(F.col("text"), 50).alias("text"))


@query
def truncated_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(ft.truncated_tokens(F.col("text")), " ").alias("tokens"))


def _feature_digest(df):
    sums = F.transform("features", lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x.cast("double")))
    rows = df.select("doc_id", F.posexplode(sums).alias("at", "total"))
    return rows.select("doc_id", "at", _r("total", "total"))


@query
def token_features(spark, sf_dir):
    return _feature_digest(ft.encode_by_lookup(_documents(spark, sf_dir), "doc_id", "text", sd.token_vectors(spark, sf_dir), 64))


def _length_encoder(texts):
    """One row per word: its length and its place."""
    return [np.array([[len(w), i] for i, w in enumerate(t.split(" "))], dtype="float32") for t in texts]


@query
def model_features(spark, sf_dir):
    return _feature_digest(ft.encode_by_model(_documents(spark, sf_dir), "doc_id", "text", _length_encoder, 2))


@query
def stacked_features(spark, sf_dir):
    features = sd.table(spark, sf_dir, "embeddings").select("vec_id", vectors.to_rows(F.col("embedding"), 8, 8).alias("features"))
    return ft.stacked(features, "vec_id").select("vec_id", F.size("features").alias("n_rows"), F.size(F.flatten("features")).alias("n_values"))


@query
def reshaped_features(spark, sf_dir):
    rows = sd.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(vectors.to_rows(F.col("embedding"), 8, 8)).alias("at", "row"))
    return rows.select("vec_id", "at", _r(F.aggregate("row", F.lit(0.0), lambda s, x: s + x.cast("double")), "total"))


@query
def zero_based_class(spark, sf_dir):
    return sd.gold_labels(spark, sf_dir).select("doc_id", em.zero_based(F.col("class")).alias("class"))


def _feature_labels(spark, sf_dir):
    features = sd.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("features"))
    return em.with_labels(features, sd.gold_labels(spark, sf_dir), "doc_id")


@query
def feature_labels(spark, sf_dir):
    return _feature_labels(spark, sf_dir).select("doc_id", "class", F.size("features").alias("width"))


@query
def train_split(spark, sf_dir):
    return em.id_range(sd.gold_labels(spark, sf_dir), "doc_id", em.GOLD_SPLIT[0])


@query
def validation_split(spark, sf_dir):
    return em.id_range(sd.gold_labels(spark, sf_dir), "doc_id", em.GOLD_SPLIT[1])


@query
def noisy_train_split(spark, sf_dir):
    docs = sd.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return em.id_range(docs, "doc_id", em.NOISY_SPLIT[0])


@query
def noisy_validation_split(spark, sf_dir):
    return em.id_range(sd.gold_labels(spark, sf_dir), "doc_id", em.NOISY_SPLIT[1])


def _losses(spark, sf_dir):
    frame = sd.logits_and_targets(spark, sf_dir)
    z, t = F.col("logits"), F.col("target")
    return frame.select("vec_id", loss.soft_cross_entropy(z, t, 3).alias("soft"),
                        loss.soft_cross_entropy(z, t, 3, [1.0, 2.0, 0.5]).alias("weighted"),
                        loss.hard_cross_entropy(z, F.col("hard"), 3).alias("hard"))


@query
def row_losses(spark, sf_dir):
    return _losses(spark, sf_dir).select("vec_id", _r("soft", "soft"), _r("weighted", "weighted"), _r("hard", "hard"))


@query
def loss_reductions(spark, sf_dir):
    rows = _losses(spark, sf_dir)
    parts = [loss.reduce_loss(rows, c, r).select(F.lit(c).alias("loss"), F.lit(r).alias("reduction"), _r(c, "value"))
             for c in ("soft", "weighted", "hard") for r in ("mean", "sum")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def batched_validation_loss(spark, sf_dir):
    return em.batched_mean_loss(_losses(spark, sf_dir), "vec_id", "hard").select(_r("hard", "val_loss"))


def _soft_features(spark, sf_dir):
    """Embeddings with gold class and the posterior of the closed-form model for the same id."""
    labels = _supervised(spark, sf_dir).select("doc_id", "class", "proba")
    features = sd.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("features"))
    return features.join(labels, "doc_id")


@query
def weighted_training_rows(spark, sf_dir):
    rows = em.weighted_rows(_soft_features(spark, sf_dir), "features", "proba")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("weight"), "weight"))


def _experiment_rows(spark, sf_dir):
    """Every document with its vector, its votes and its class, if it has one."""
    voted = _gold_votes(spark, sf_dir).select("doc_id", "votes", "class")
    return durable(voted.join(sd.document_vectors(spark, sf_dir), "doc_id"))


def _experiments(spark, sf_dir):
    """Both experiments, by name: gold rows alone, and the label model's answers on the rows without a class."""
    rows = _experiment_rows(spark, sf_dir)
    return {"gold": training.gold_experiment(rows, "doc_id", max_iter=20, reg=0.01),
            "noisy": training.noisy_experiment(rows, "doc_id", N_RULES, max_iter=20, reg=0.01)[0]}


def _named_union(parts):
    out = None
    for name, part in parts:
        named = part.withColumn("experiment", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


@query
def end_model_predictions(spark, sf_dir):
    """Noise-aware model: trained on the label model's answers, applied to gold rows it has not seen."""
    done = training.noisy_experiment(_experiment_rows(spark, sf_dir), "doc_id", N_RULES, max_iter=20, reg=0.01)[0]
    return done.predictions.select("doc_id", "class", "predicted", _r("loss", "loss"))


@query
def end_model_scores(spark, sf_dir):
    return training.noisy_experiment(_experiment_rows(spark, sf_dir), "doc_id", N_RULES, max_iter=20, reg=0.01)[0].scores


@query
def baseline_model_scores(spark, sf_dir):
    """The same classifier trained on the first four fifths of the gold rows, judged on the last."""
    return training.gold_experiment(_experiment_rows(spark, sf_dir), "doc_id", max_iter=20, reg=0.01).scores


@query
def experiment_rows(spark, sf_dir):
    """Rows each experiment learns from and is judged on, and how many are in both."""
    parts = []
    for name, done in _experiments(spark, sf_dir).items():
        ids, judged = done.train.select("doc_id"), done.predictions.select("doc_id")
        both = ids.join(judged, "doc_id").agg(F.count(F.lit(1)).alias("n_both"))
        n = judged.agg(F.count(F.lit(1)).alias("n_judged"))
        parts.append((name, ids.agg(F.count(F.lit(1)).alias("n_train"), F.lit(n.scalar()).alias("n_judged"),
                                    F.lit(both.scalar()).alias("n_both"))))
    return _named_union(parts)


@query
def experiment_checks(spark, sf_dir):
    """What must hold of any trained model: probabilities add up to 1, the prediction has the highest, each judged row has one answer."""
    best = F.get(F.array(*[F.lit(c) for c in lb.CLASSES]), (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))
    total = F.aggregate("probability", F.lit(0.0), lambda s, x: s + x)
    return _named_union(
        (name, done.predictions.select("doc_id", "class", (F.abs(total - 1) < 1e-9).alias("adds_up"), (best == F.col("predicted")).alias("is_best"),
                                       (F.col("loss") >= 0).alias("has_loss")))
        for name, done in _experiments(spark, sf_dir).items())


@query
def experiment_losses(spark, sf_dir):
    """Loss in batches on the rows each model has not seen, beside that of answering the mean of its training labels."""
    return _named_union(
        (name, done.validation_loss.select(_r("loss", "val_loss"), _r(training.balance_loss(done.train, done.predictions).scalar(), "balance_loss")))
        for name, done in _experiments(spark, sf_dir).items())
