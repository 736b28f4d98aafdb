"""All queries over the note and word operators, with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions.quantize import Grid
from .operators import analysis, anticipation, augment, corpus, decoding, doubling, lines, merges, windows
from .operators import notes as N
from .plans import runs
from .plans import sweep as S
from .plans.tables import settled
from .sources.notes import notes_from_events, notes_from_lineitem, words_from_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K, LADDER, WINDOW = O.K, [0, 2, 4, 8], 64
CHUNK = ("file_id", "chunk_idx")


def recursive(*ctes: str, final: str) -> str:
    return O.statement(*ctes, final=final).replace("with ", "with recursive ", 1)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    return notes_from_events(table(spark, sf_dir, source)) if source == "events" else notes_from_lineitem(table(spark, sf_dir, source))


def notes(spark: SparkSession, sf_dir: str, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    return N.notes(raw(spark, sf_dir), grid)


FIVE = ["t", "d", "p", "i", "v"]

# Notes.


@query("note_quantize", O.statement(O.raw(), O.quantized(Grid(vel_bins=32)), final="select * from q"))
def note_quantize(spark, sf_dir):
    return N.quantize(raw(spark, sf_dir), Grid(vel_bins=32))


@query("note_quantize_lineitem", O.statement(O.raw("lineitem"), O.quantized(Grid()), final="select file_id, ord, t, d, p, i, v from q"))
def note_quantize_lineitem(spark, sf_dir):
    return N.quantize(raw(spark, sf_dir, "lineitem"), Grid())


@query("note_chunk_rezero", O.statement(*O.notes(), final="select * from notes"))
def note_chunk_rezero(spark, sf_dir):
    return notes(spark, sf_dir)


@query("chunk_summary_lineitem", O.statement(*O.notes(source="lineitem"), final="select file_id, count(distinct chunk_idx) as n_chunks, count(*) as n_notes, max(t) as last_t, sum(d)::bigint as total_d from notes group by file_id"))
def chunk_summary_lineitem(spark, sf_dir):
    n = N.notes(raw(spark, sf_dir, "lineitem"))
    return n.groupBy("file_id").agg(F.countDistinct("chunk_idx").alias("n_chunks"), F.count("*").alias("n_notes"), F.max("t").alias("last_t"), F.sum("d").alias("total_d"))


@query("inverse_quantize", O.statement(*O.notes(Grid(vel_bins=32)), final=f"select file_id, chunk_idx, pos, t * 0.01::double as start_sec, t * 0.01::double + d * 0.01::double as end_sec, least(127, greatest(0, p)) as pitch, case when i = 128 then 0 else least(i, 127) end::bigint as program, i = 128 as is_drum, least(127, greatest(1, {O.even('v * 127 / 31::double')})) as velocity from notes"))
def inverse_quantize(spark, sf_dir):
    grid = Grid(vel_bins=32)
    return N.inverse(notes(spark, sf_dir, grid), grid)


@query("trim_notes", O.statement(O.raw(), final="select file_id, ord, start_sec, least(end_sec, 120::double) as end_sec, pitch::bigint as pitch, program, is_drum, velocity from raw where start_sec < 120"))
def trim_notes(spark, sf_dir):
    return N.trimmed(raw(spark, sf_dir), 120.0)


# Dictionaries and serialization.


@query("base_vocab", O.statement(*O.notes(), O.vocabulary(), final="select token, idx from vocab"))
def base_vocab(spark, sf_dir):
    return corpus.vocabulary(notes(spark, sf_dir)).select("token", "idx")


@query("base_vocab_by_category", O.statement(*O.notes(), O.vocabulary(), final="select category, count(*) as n_tokens from vocab group by category"))
def base_vocab_by_category(spark, sf_dir):
    return corpus.category_counts(notes(spark, sf_dir))


@query("control_dictionary", O.statement(*O.notes(), O.vocabulary(), final="select token, idx, false as is_ctrl from vocab union all select token, idx + (select count(*) from vocab), true from vocab"))
def control_dictionary(spark, sf_dir):
    return corpus.with_controls(corpus.vocabulary(notes(spark, sf_dir)))


def indexed(spark, sf_dir, grid: Grid = Grid()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    n = notes(spark, sf_dir, grid)
    vocab = settled(corpus.vocabulary(n))
    return corpus.with_indices(n, vocab), vocab


SERIALIZED = "select file_id, chunk_idx, string_agg(word, ' ' order by pos, part) as text from each group by file_id, chunk_idx"


@query("serialize_compound", O.statement(*O.notes(), O.vocabulary(), O.indexed(), O.words(), final=SERIALIZED))
def serialize_compound(spark, sf_dir):
    return corpus.lines(corpus.words_of(indexed(spark, sf_dir)[0]))


@query("serialize_onset_standalone", O.statement(*O.notes(), O.vocabulary(), O.indexed(), O.words(standalone=True), final=SERIALIZED))
def serialize_onset_standalone(spark, sf_dir):
    return corpus.lines(corpus.words_of(indexed(spark, sf_dir)[0], standalone=True))


HALF = [*O.notes(), "most as (select * from notes where file_id % 4 <> 1)", O.vocabulary("most"), O.indexed()]
MISSING = " or ".join(f"{f}_idx is null" for f in FIVE)


def half_indexed(spark, sf_dir) -> DataFrame:
    n = notes(spark, sf_dir)
    return corpus.with_indices(n, corpus.vocabulary(n.where(F.col("file_id") % 4 != 1)))


@query("oov_file_veto", O.statement(*HALF, final=f"select file_id, count(*) as n_notes from ix where file_id not in (select file_id from ix where {MISSING}) group by file_id"))
def oov_file_veto(spark, sf_dir):
    return corpus.known(half_indexed(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("n_notes"))


@query("oov_chunk_veto", O.statement(*HALF, final=f"select file_id, chunk_idx, count(*) as n_notes from ix where (file_id, chunk_idx) not in (select (file_id, chunk_idx) from ix where {MISSING}) group by file_id, chunk_idx"))
def oov_chunk_veto(spark, sf_dir):
    return corpus.known(half_indexed(spark, sf_dir), "chunk").groupBy("file_id", "chunk_idx").agg(F.count("*").alias("n_notes"))


def _coarsen(name: str, field: str, fine: float, coarse: float) -> None:
    cols = ", ".join((O.coarse(field, fine, coarse) if f == field else f) + f" as {f}" for f in FIVE)

    @query(name, O.statement(*O.notes(corpus.fine_grid(field, fine)), final=f"select file_id, chunk_idx, pos, {cols} from notes"))
    def run(spark, sf_dir):
        n = notes(spark, sf_dir, corpus.fine_grid(field, fine))
        return corpus.coarsened(n, field, fine, coarse).select("file_id", "chunk_idx", "pos", *FIVE)


_coarsen("coarsen_onset", "t", 1, 20)
_coarsen("coarsen_duration", "d", 1, 20)
_coarsen("coarsen_velocity", "v", 128, 32)

RESCAN = [O.raw(), O.quantized(Grid(onset_ms=1.0), "qf"), O.chunked(Grid(onset_ms=1.0), "nf", "qf"), O.quantized(Grid(onset_ms=20.0)), O.chunked(Grid(onset_ms=20.0))]


@query("coarsen_vs_rescan", O.statement(*RESCAN, final=f"select count(*) as n_notes, count(*) filter (where {O.coarse('t', 1, 20, 'a.t')} <> b.t) as n_onsets_differ, count(*) filter (where a.chunk_idx <> b.chunk_idx) as n_chunks_differ from nf a join notes b using (file_id, ord)"))
def coarsen_vs_rescan(spark, sf_dir):
    a = corpus.coarsened(notes(spark, sf_dir, Grid(onset_ms=1.0)), "t", 1, 20).select("file_id", "ord", F.col("t").alias("t1"), F.col("chunk_idx").alias("c1"))
    b = notes(spark, sf_dir, Grid(onset_ms=20.0))
    return a.join(b, ["file_id", "ord"]).agg(F.count("*").alias("n_notes"), F.count_if(F.col("t1") != F.col("t")).alias("n_onsets_differ"), F.count_if(F.col("c1") != F.col("chunk_idx")).alias("n_chunks_differ"))


# Words and merges.


def note_words(spark, sf_dir, standalone: bool = False) -> tuple[DataFrame, DataFrame]:
    """Counted words and their dictionary, both settled: whoever trains on them reads them again."""
    n = settled(corpus.counted_notes(notes(spark, sf_dir)))  # files and chunks don't matter from here on
    vocab = settled(corpus.vocabulary(n))
    words = corpus.words_of(corpus.with_symbols(n, vocab), standalone).select("word", "n")
    return settled(corpus.summed(words) if standalone else words), vocab  # as whole words they are as distinct as the notes


def text_words(spark, sf_dir, source: str) -> DataFrame:
    return merges.of_characters(words_from_text(table(spark, sf_dir, source)))


def settled_text_words(spark, sf_dir, source: str) -> DataFrame:
    return settled(text_words(spark, sf_dir, source))


def grouped(words: DataFrame) -> DataFrame:
    return words.withColumn("grp", F.lit("all"))


@query("word_counts_notes", O.statement(*O.notes(), O.vocabulary(), O.indexed(), O.words(), O.COUNTED, final="select word, n from words"))
def word_counts_notes(spark, sf_dir):
    return note_words(spark, sf_dir)[0]


@query("word_counts_lineitem", O.statement(*O.notes(source="lineitem"), O.vocabulary(), O.indexed(), O.words(), O.COUNTED, final="select word, n from words"))
def word_counts_lineitem(spark, sf_dir):
    n = N.notes(raw(spark, sf_dir, "lineitem"))
    return corpus.counted(corpus.words_of(corpus.with_indices(n, corpus.vocabulary(n))))


@query("word_counts_text", O.statement(*O.text_words("documents"), final="select word, n from plain"))
def word_counts_text(spark, sf_dir):
    return words_from_text(table(spark, sf_dir, "documents"))


@query("pair_counts", O.statement(*O.text_words("documents"), "w as (select grp, n, word as sym from words)", final=f"select l, r, c as n from ({O.pairs_of('w')})"))
def pair_counts(spark, sf_dir):
    return merges.pairs(text_words(spark, sf_dir, "documents"))


@query("pair_counts_notes", O.statement(*O.notes(), O.vocabulary(), O.indexed(), O.words(), O.COUNTED, "w as (select grp, n, word as sym from words)", final=f"select l, r, c as n from ({O.pairs_of('w')})"))
def pair_counts_notes(spark, sf_dir):
    return merges.pairs(note_words(spark, sf_dir)[0])


@query("top_pair", O.statement(*O.text_words("documents"), "w as (select grp, n, word as sym from words)", final=f"select l, r, c as n from ({O.pairs_of('w')}) order by c desc, l, r limit 1"))
def top_pair(spark, sf_dir):
    return merges.top_pair(text_words(spark, sf_dir, "documents"))


def merge_table(spark, rules) -> DataFrame:
    return spark.createDataFrame([(k, *x) for k, x in enumerate(rules)], "rank long, l string, r string, made string")


MERGES = f"select rank::bigint as rank, l, r, made from ({O.merges()})"


@query("bpe_merges_notes", O.statement(*O.trained_notes(), final=MERGES))
def bpe_merges_notes(spark, sf_dir):
    return merge_table(spark, merges.train_one(note_words(spark, sf_dir)[0], K))


@query("bpe_merges_text", O.statement(*O.text_words("documents"), *O.training(), final=MERGES))
def bpe_merges_text(spark, sf_dir):
    return merge_table(spark, merges.train_one(settled_text_words(spark, sf_dir, "documents"), K))


@query("bpe_merges_distributed", O.statement(*O.text_words("conversations"), *O.training(), final=MERGES))
def bpe_merges_distributed(spark, sf_dir):
    return merge_table(spark, merges.train_one(settled_text_words(spark, sf_dir, "conversations"), K, most=0))


@query("bpe_encode_lengths", O.statement(*O.trained_notes(), final=f"select {O.tokens_in('sym')}::bigint as n_tokens, count(*) as n_distinct_words, sum(n)::bigint as n_words from w{K} group by 1"))
def bpe_encode_lengths(spark, sf_dir):
    words = note_words(spark, sf_dir)[0]
    enc = merges.encoded(words, merges.train_one(words, K))
    return enc.groupBy(merges.count_symbols(F.col("enc")).alias("n_tokens")).agg(F.count("*").alias("n_distinct_words"), F.sum("n").alias("n_words"))


def _ladder(name: str, ctes: list[str], words_of) -> None:
    @query(name, O.statement(*ctes, final=O.ladder(LADDER)))
    def run(spark, sf_dir):
        words = grouped(words_of(spark, sf_dir))
        return merges.evaluate(words, merges.train(words, max(LADDER)), LADDER)


_ladder("bpe_eval_ladder_notes", O.trained_notes(), lambda s, d: note_words(s, d)[0])
_ladder("bpe_eval_ladder_text", [*O.text_words("documents"), *O.training()], lambda s, d: settled_text_words(s, d, "documents"))
_ladder("bpe_eval_ladder_conversations", [*O.text_words("conversations"), *O.training()], lambda s, d: settled_text_words(s, d, "conversations"))
_ladder("bpe_onset_barrier_eval", O.trained_notes(standalone=True), lambda s, d: note_words(s, d, standalone=True)[0])

# Analyses.


def analysed(spark, sf_dir, k: int = K) -> tuple[DataFrame, DataFrame]:
    words, vocab = note_words(spark, sf_dir)
    rules, standing = merges.trained_one(words, k)
    # Words that were trained have been encoded by that: only those beyond what the tasks hold are encoded anew.
    freq = analysis.frequencies(merges.encoded(words, rules)) if standing is None else analysis.frequency_table(spark, standing)
    return analysis.token_table(vocab, rules), freq


ANALYSED = [*O.trained_notes(), *O.expansions()]


@query("token_frequency", O.statement(*ANALYSED, final="select original_tokens, n as corpus_count, printf('%.4f', n / (select sum(n) from freq)::double * 100) as percentage, size::bigint as token_length from tf where n > 0"))
def token_frequency(spark, sf_dir):
    return analysis.token_frequency(*analysed(spark, sf_dir))


@query("category_counts", O.statement(*ANALYSED, final="select category, count(*) as merged_vocab_count, sum(n)::bigint as corpus_weighted_count from (select n, unnest(string_split(categories, '+')) as category from tf where size > 1) group by category"))
def category_counts(spark, sf_dir):
    return analysis.merged_categories(*analysed(spark, sf_dir))


@query("component_analysis", O.statement(*ANALYSED, final=f"select * exclude (merges) from ({O.component(K)}) where top <= 10"))
def component_analysis(spark, sf_dir):
    return analysis.component_analysis(*analysed(spark, sf_dir)).where("top <= 10")


@query("token_length_hist", O.statement(*ANALYSED, final="select size::bigint as token_length, count(*) as vocab_count from toks group by size"))
def token_length_hist(spark, sf_dir):
    return analysis.length_histogram(analysed(spark, sf_dir)[0])


@query(
    "vocab_summary",
    O.statement(
        *ANALYSED,
        final="""select (select count(*) + 4 from toks) as vocab_size, (select count(*) from toks where size > 1) as num_merged_tokens, (select round_even(avg(size), 4) from toks) as average_bpe_token_length,
  (select sum(n)::bigint from freq) as total_bpe_tokens,
  (select string_agg(original_tokens || '=' || n, '; ' order by n desc, sym) from (select * from tf order by n desc, sym limit 10)) as most_common""",
    ),
)
def vocab_summary(spark, sf_dir):
    return analysis.summary(*analysed(spark, sf_dir))


@query("component_stack", O.statement(*O.trained_notes(4), *O.expansions(4), final=O.component(4)))
def component_stack(spark, sf_dir):
    return analysis.stacked({4: analysis.component_analysis(*analysed(spark, sf_dir, 4))})


@query("component_stack_sizes", O.statement(*O.trained_notes(), *O.expansions(4, "4"), *O.expansions(8, "8"), final=f"{O.component(4, 'tf4')} union all {O.component(8, 'tf8')}"))
def component_stack_sizes(spark, sf_dir):
    """Two vocabularies on top of each other, of one training: the smaller one's merges are the first of the larger one's."""
    words, vocab = note_words(spark, sf_dir)
    rules = merges.train_one(words, 8)
    return analysis.stacked({k: analysis.component_analysis(analysis.token_table(vocab, rules[:k]), analysis.frequencies(merges.encoded(words, rules[:k]))) for k in (4, 8)})


# At the sizes of real vocabularies: no SQL, held against a library and a plain model in the tests.
FULL_LADDER = [0, *(256 * 2**k for k in range(9))]
FULL = 8192


@query("bpe_full_ladder_text", None)
def bpe_full_ladder_text(spark, sf_dir):
    """0 and 256 to 65,536 merges, trained once; a size beyond what there is to merge has the counts of the last one."""
    words = grouped(settled_text_words(spark, sf_dir, "documents"))
    return merges.evaluate(words, merges.train(words, max(FULL_LADDER)), FULL_LADDER)


@query("bpe_full_ladder_notes", None)
def bpe_full_ladder_notes(spark, sf_dir):
    words = grouped(note_words(spark, sf_dir)[0])
    return merges.evaluate(words, merges.train(words, max(FULL_LADDER)), FULL_LADDER)


@query("component_analysis_full", None)
def component_analysis_full(spark, sf_dir):
    return analysis.component_analysis(*analysed(spark, sf_dir, FULL))


@query("vocab_summary_full", None)
def vocab_summary_full(spark, sf_dir):
    return analysis.summary(*analysed(spark, sf_dir, FULL))


# Stored corpora.


def stored_lines(spark, sf_dir, grid: Grid = Grid()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(file_id, chunk_idx, text) of private-use characters, as a corpus file has them, and the dictionary."""
    ix, vocab = indexed(spark, sf_dir, grid)
    return corpus.lines(corpus.words_of(ix)).withColumn("text", corpus.private_use_words(F.col("text"))), vocab


def _private_words(indices: list[str]) -> str:
    return " || ".join(O.private(i) for i in indices)


STORED = f"select file_id, chunk_idx, string_agg({_private_words([f'{f}_idx' for f in FIVE])}, ' ' order by pos) as text from ix group by file_id, chunk_idx"


@query("coarsen_stored_lines", O.statement(*O.notes(Grid(onset_ms=1.0)), f"coarse as (select * replace ({O.coarse('t', 1, 20)} as t) from notes)", O.vocabulary("coarse"), O.indexed("coarse"), final=STORED))
def coarsen_stored_lines(spark, sf_dir):
    """By the dictionary alone: the lines are translated character by character."""
    text, vocab = stored_lines(spark, sf_dir, Grid(onset_ms=1.0))
    return lines.coarsened_lines(text, vocab, "t", 1, 20)[0]


APART = _private_words(["t_idx"]) + " || ' ' || " + _private_words([f"{f}_idx" for f in FIVE[1:]])


@query("split_stored_lines", O.statement(*O.notes(), O.vocabulary(), O.indexed(), final=f"select file_id, chunk_idx, string_agg({APART}, ' ' order by pos) as text, 5 * count(*)::bigint as n_tokens from ix group by file_id, chunk_idx"))
def split_stored_lines(spark, sf_dir):
    text = stored_lines(spark, sf_dir)[0].withColumn("text", lines.onsets_apart(F.col("text")))
    return text.withColumn("n_tokens", lines.original_length(F.col("text")))


@query("decode_stored_lines", O.statement(*O.notes(), final="select file_id, chunk_idx, pos, false as is_control, " + " || ' ' || ".join(f"'<{c}-' || {f} || '>'" for c, f in zip(O.CATEGORIES, FIVE, strict=True)) + " as tokens from notes"))
def decode_stored_lines(spark, sf_dir):
    out = lines.notes_of_lines(*stored_lines(spark, sf_dir))
    return out.withColumn("tokens", F.array_join("tokens", " "))


@query("decode_augmented_lines", None)
def decode_augmented_lines(spark, sf_dir):
    """Events of augmented lines, controls stripped and sentinels passed over."""
    n = notes(spark, sf_dir)
    vocab = settled(corpus.vocabulary(n))
    text = augment.sequence_lines(augment.augmented(n, augment.all_passes(n, PASSES)), vocab).where("k = 2")
    return lines.notes_of_lines(text, vocab).groupBy("file_id", "chunk_idx").agg(F.count("*").alias("n_events"), F.sum(F.size("tokens")).alias("n_tokens"))


# Controls, rests and sequences.


@query("rest_gap_fill", O.statement(*O.notes(), O.controls("false"), *O.padded(), final="select file_id, chunk_idx, time, kind, t, d, p, i, v from padded"))
def rest_gap_fill(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("is_control", F.lit(False))
    return anticipation.padded(n, Grid()).select("file_id", "chunk_idx", "time", "kind", *FIVE)


CONTROLS = "select file_id, chunk_idx, pos, ord, t, d, p, i, v, is_control from nc"
SPANS = [(500, 1500), (4000, 4500)]


@query("controls_random", O.statement(*O.notes(), O.controls(O.RANDOM_CONTROL), final=CONTROLS))
def controls_random(spark, sf_dir):
    return anticipation.by_rate(notes(spark, sf_dir), 3)


@query("controls_instrument", O.statement(*O.notes(), O.controls("i in (24, 128)"), final=CONTROLS))
def controls_instrument(spark, sf_dir):
    return anticipation.by_instruments(notes(spark, sf_dir), [24, 128])


@query("controls_span", O.statement(*O.notes(), O.controls("(t between 500 and 1500) or (t between 4000 and 4500)"), final=CONTROLS))
def controls_span(spark, sf_dir):
    return anticipation.by_spans(notes(spark, sf_dir), SPANS)


@query("build_sequence", O.statement(*O.notes(), O.controls(O.RANDOM_CONTROL), *O.sequence(), final="select * from seq"))
def build_sequence(spark, sf_dir):
    return anticipation.sequence(anticipation.by_rate(notes(spark, sf_dir), 3), Grid())


@query("interleave", O.statement(*O.notes(), O.controls("i in (24, 128)"), *O.sequence(), final="select file_id, chunk_idx, seq, kind, t from seq"))
def interleave(spark, sf_dir):
    return anticipation.sequence(anticipation.by_instruments(notes(spark, sf_dir), [24, 128]), Grid()).select("file_id", "chunk_idx", "seq", "kind", "t")


@query(
    "sequence_keeps_notes",
    O.statement(
        *O.notes(),
        O.controls(O.RANDOM_CONTROL),
        *O.sequence(),
        "before as (select file_id, chunk_idx, t, d, p, i, v, is_control from nc)",
        "after as (select file_id, chunk_idx, t, d, p, i, v, kind = 'CONTROL' from seq where kind in ('EVENT', 'CONTROL'))",
        final="""select (select count(*) from before) as n_notes, (select count(*) from (select * from before except all select * from after)) as n_lost,
  (select count(*) from (select * from after except all select * from before)) as n_made""",
    ),
)
def sequence_keeps_notes(spark, sf_dir):
    n = anticipation.by_rate(notes(spark, sf_dir), 3)
    cols = ["file_id", "chunk_idx", *FIVE, "is_control"]
    before = n.select(*cols)
    after = anticipation.sequence(n, Grid()).where("kind in ('EVENT', 'CONTROL')").select("file_id", "chunk_idx", *FIVE, (F.col("kind") == "CONTROL").alias("is_control"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(before, "n_notes").join(count(before.exceptAll(after), "n_lost")).join(count(after.exceptAll(before), "n_made"))


def _schedule_sql() -> str:
    h = lambda *keys, salt: O.draw(1_000_000, *keys, salt=salt)
    return O.statement(
        *O.notes(),
        "files as (select file_id, list_sort(list(distinct i)) as insts from notes group by file_id)",
        f"each as (select *, case when len(insts) > 1 then 1 + {h('file_id', 'k', salt=2)} % (len(insts) - 1) end as c from (select *, unnest(range(0, 10)) as k from files))",
        f"drawn as (select file_id, k, i, c, row_number() over (partition by file_id, k order by {h('file_id', 'k', 'i', salt=3)}, i) as at_ from (select *, unnest(insts) as i from each))",
        "subsets as (select file_id, k, string_agg(i::varchar, ',' order by i) as subset from drawn where at_ <= c group by file_id, k)",
        "modes as (select *, case when k % 10 = 0 then 'none' when k % 10 = 1 then 'span' when k % 10 < 6 then 'random' when len(insts) > 1 then 'instrument' else 'none' end as mode from each)",
        final=f"select file_id, k, mode, case when mode = 'random' then 1 + {O.draw(9, 'file_id', 'k', salt=1)} end as rate, case when mode = 'instrument' then subset end as subset from modes left join subsets using (file_id, k)",
    )


@query("augment_schedule", _schedule_sql())
def augment_schedule(spark, sf_dir):
    return anticipation.schedule(notes(spark, sf_dir))


SPAN_CONTROL = "exists (select 1 from own_spans s where s.file_id = n.file_id and s.chunk_idx = n.chunk_idx and n.t between s.a and s.b)"


@query("span_state_machine", recursive(*O.notes(), *O.spans(keys=CHUNK), final=f"select *, {SPAN_CONTROL} as is_control from notes n"))
def span_state_machine(spark, sf_dir):
    n = notes(spark, sf_dir)
    return anticipation.by_own_spans(n, anticipation.sampled_spans(n, Grid(), uniform=anticipation.drawn(*CHUNK, salt=13)))


@query("augment_schedule_chunks", O.statement(*O.notes(), *O.schedule(10, CHUNK), final="select * from chosen"))
def augment_schedule_chunks(spark, sf_dir):
    """Drawn for each chunk, from the instruments of its own."""
    return anticipation.schedule(notes(spark, sf_dir), by=CHUNK)


PASSES = 7  # none, spans, drawn rates, instruments
PASS = (*CHUNK, "k")


def _in_passes(passes: int) -> list[str]:
    """nc(file_id, chunk_idx of the pass, ..): as the sequences of all passes are one, a chunk's number tells the pass, too."""
    random = f"{O.draw(10_000, 'n.file_id', 'n.ord', 'n.k', salt=14)} < n.rate * 1000"
    inside = "exists (select 1 from own_spans s where s.file_id = n.file_id and s.chunk_idx = n.chunk_idx and s.k = n.k and n.t between s.a and s.b)"
    return [
        *O.schedule(passes, CHUNK),
        "each_note as materialized (select n.*, k, mode, rate, subset from notes n join chosen using (file_id, chunk_idx))",
        *O.spans("mode = 'span'", PASS, of="each_note"),
        f"""nc as materialized (select file_id, chunk_idx * {passes} + k as chunk_idx, pos, ord, t, d, p, i, v,
  case mode when 'random' then {random} when 'instrument' then list_contains(string_split(subset, ','), i::varchar) when 'span' then {inside} else false end as is_control from each_note n)""",
    ]


def _line_words(passes: int) -> list[str]:
    own = " || ".join(O.private(f"(v_{f}.idx + case when kind = 'CONTROL' then (select count(*) from vocab) else 0 end)") for f in FIVE)
    joins = " ".join(f"left join vocab v_{f} on v_{f}.token = '<{c}-' || s.{f} || '>'" for c, f in zip(O.CATEGORIES, FIVE, strict=True))
    return [f"line_words as (select file_id, chunk_idx // {passes} as chunk_idx, chunk_idx % {passes} as k, seq, case when kind in ('EVENT', 'CONTROL') then {own} else '[' || kind || ']' end as word from seq s {joins})"]


@query(
    "augmented_corpus",
    recursive(*O.notes(), O.vocabulary(), *_in_passes(PASSES), *O.sequence(), *_line_words(PASSES), final="select file_id, chunk_idx, k, string_agg(word, ' ' order by seq) as text from line_words group by all"),
)
def augmented_corpus(spark, sf_dir):
    n = notes(spark, sf_dir)
    return augment.sequence_lines(augment.augmented(n, augment.all_passes(n, PASSES)), settled(corpus.vocabulary(n)))


EPOCH = f"select file_id, case when {O.draw(10_000, 'file_id', '3', salt=11)} < 7000 then 1 + {O.draw(9, 'file_id', '3', salt=12)} else 0 end::bigint as k from (select distinct user_id as file_id from events)"


@query("epoch_draw", EPOCH)
def epoch_draw(spark, sf_dir):
    return augment.epoch(raw(spark, sf_dir), 0.7, 3)


# Windows and shards.


def encoded_words(spark, sf_dir) -> tuple[DataFrame, list, DataFrame]:
    ix, vocab = indexed(spark, sf_dir)
    each = corpus.words_of(ix)
    rules = merges.train_one(settled(corpus.counted(each)), K)
    return decoding.encoded_notes(each, rules), rules, vocab


EACH_ENCODED = f"enc as (select e.file_id, e.chunk_idx, e.pos, string_split(sym[2:-2], '][') as s from each e join w{K} w on w.word = e.word)"
STREAM = "stream as materialized (select file_id, chunk_idx, s[j] as sym, row_number() over (partition by file_id order by chunk_idx, pos, j) - 1 as at_ from (select *, unnest(range(1, len(s) + 1)) as j from enc))"


@query(
    "positional_windows",
    O.statement(*O.trained_notes(), EACH_ENCODED, STREAM, final=f"select file_id, at_ // {WINDOW} as win, count(*) filter (where sym in ('M00000', 'M00001')) as n_marked, min_by(sym, at_) as first_sym, max_by(sym, at_) as last_sym from stream group by file_id, at_ // {WINDOW} having count(*) = {WINDOW}"),
)
def positional_windows(spark, sf_dir):
    return windows.packed_windows(windows.id_stream(encoded_words(spark, sf_dir)[0]), WINDOW, ["M00000", "M00001"])


@query(
    "packing_compare",
    O.statement(
        *O.trained_notes(),
        EACH_ENCODED,
        "f as (select file_id, count(*) * 5 as plain, count(*) as notes, sum(len(s))::bigint as bpe from enc group by file_id)",
        final=f"""select count(*) as n_files, sum(plain)::bigint as plain_tokens, sum(bpe)::bigint as bpe_tokens, sum(plain // {WINDOW} * {WINDOW})::bigint as plain_packed, sum(bpe // {WINDOW} * {WINDOW})::bigint as bpe_packed,
  sum(plain // {WINDOW} * {WINDOW} // 5)::bigint as plain_notes_packed, sum(bpe // {WINDOW} * {WINDOW} * notes // greatest(1, bpe))::bigint as bpe_notes_packed, sum(bpe // {WINDOW})::bigint as n_windows from f""",
    ),
)
def packing_compare(spark, sf_dir):
    enc = encoded_words(spark, sf_dir)[0]
    return windows.packing(enc.select("file_id", merges.count_symbols(F.col("enc")).alias("n_tokens")), WINDOW)


COMPARED = [
    *O.trained_notes(),
    O.controls(O.RANDOM_CONTROL),
    *O.sequence(),
    O.indexed("seq", name="sx"),
    f"st as materialized (select file_id, chunk_idx, seq, kind = 'CONTROL' as is_control, kind in ('EVENT', 'CONTROL') as is_note, coalesce({O.tokens_in('w.sym')}, 1)::bigint as n from (select *, {O.COMPOUND} as word from sx) x left join w{K} w using (word))",
    "tk as (select file_id, is_control, row_number() over (partition by file_id order by chunk_idx, seq, j) - 1 as at_ from (select *, unnest(range(n)) as j from st))",
    f"wn as (select file_id, bool_or(is_control) as c from tk group by file_id, at_ // {WINDOW} having count(*) = {WINDOW})",
    """f as (select file_id, bpe, ctrl, words, plain from (select file_id, sum(n)::bigint as bpe, coalesce(sum(n) filter (is_control), 0)::bigint as ctrl, count(*) filter (is_note) as words from st group by file_id)
  join (select file_id, 5 * count(*) as plain from notes group by file_id) using (file_id))""",
    f"""sums as (select count(*) as n_files, sum(plain)::bigint as plain_tokens, sum(bpe)::bigint as bpe_tokens, sum(ctrl)::bigint as ctrl_tokens, sum(plain // {WINDOW} * {WINDOW})::bigint as plain_packed, sum(bpe // {WINDOW} * {WINDOW})::bigint as bpe_packed,
  sum(plain // {WINDOW} * {WINDOW} // 5)::bigint as plain_notes_packed, sum(bpe // {WINDOW} * {WINDOW} * words // greatest(1, bpe))::bigint as bpe_words_packed, (select count(*) from wn) as n_windows, (select count(*) from wn where c) as n_anticipate from f)""",
]


@query("compare_encodings", O.statement(*COMPARED, final="select *, plain_tokens / greatest(1, bpe_tokens) as compression, n_anticipate / greatest(1, n_windows) as anticipate_fraction, ctrl_tokens / greatest(1, bpe_tokens) as ctrl_fraction from sums"))
def compare_encodings(spark, sf_dir):
    n = notes(spark, sf_dir)
    words, vocab = note_words(spark, sf_dir)
    return runs.compare(n, anticipation.sequence(anticipation.by_rate(n, 3), Grid()), vocab, merges.train_one(words, K), WINDOW)


@query(
    "window_prefix",
    O.statement(
        *O.notes(),
        O.vocabulary(),
        O.controls(O.RANDOM_CONTROL),
        *O.sequence(),
        O.sequence_ids(),
        f"firsts as (select * from (select *, row_number() over (partition by file_id, chunk_idx order by seq, j) as at_ from sid) where at_ <= {WINDOW})",
        final=f"""select file_id, chunk_idx, bool_or(is_control) as anticipates, case when bool_or(is_control) then '[ANTICIPATE]' else '[AUTOREGRESS]' end || ' ' || string_agg(id, ' ' order by at_) filter (where at_ < {WINDOW}) as ids
  from firsts group by file_id, chunk_idx having count(*) = {WINDOW}""",
    ),
)
def window_prefix(spark, sf_dir):
    n = notes(spark, sf_dir)
    seq = anticipation.sequence(anticipation.by_rate(n, 3), Grid())
    return windows.training_windows(windows.sequence_ids(seq, corpus.vocabulary(n)), WINDOW)


@query("shard_files", O.statement(*O.notes(), f"f as (select file_id, row_number() over (order by {O.draw(1_000_000_007, 'file_id', salt=5)}, file_id) - 1 as place from (select distinct file_id from notes))", final="select file_id, place, place % 4 as rank, place // 4 % 2 as worker from f"))
def shard_files(spark, sf_dir):
    return windows.shards(raw(spark, sf_dir), 4, 2)


FINGERPRINT_BUCKETS = 64


@query(
    "fingerprint",
    "with f as (select user_id as file_id, max(epoch_us(ts)) as m from events group by user_id), "
    f"b as (select file_id % {FINGERPRINT_BUCKETS} as b, sha1(string_agg(file_id || ':' || m, chr(10) order by file_id)) as h from f group by 1) "
    "select sha1('onset_ms=10' || chr(10) || string_agg(h, chr(10) order by b)) as fingerprint from b",
)
def fingerprint(spark, sf_dir):
    """Of parameters and files with their times: by buckets first, so that no row holds all files."""
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("m"))
    line = F.struct("file_id", F.concat_ws(":", F.col("file_id").cast("string"), F.col("m").cast("string")).alias("x"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda v: v["x"]), "\n")
    b = f.groupBy(F.pmod("file_id", F.lit(FINGERPRINT_BUCKETS)).alias("b")).agg(F.sha1(join(line)).alias("h"))
    return b.agg(F.sha1(F.concat(F.lit("onset_ms=10\n"), join(F.struct("b", F.col("h").alias("x"))))).alias("fingerprint"))


# Doubling and decoding.


@query("double_vocab", O.statement(*O.trained_notes(), *O.expansions(), "mt as (select joined, row_number() over (order by min(sym)) - 1 as k from toks where size > 1 group by joined)", "size as (select (select count(*) from vocab) as b, (select count(*) from mt) as m)", final=O.doubled()))
def double_vocab(spark, sf_dir):
    words, vocab = note_words(spark, sf_dir)
    return doubling.ids(vocab, merges.train_one(words, K))


@query(
    "double_merges",
    O.statement(
        *O.trained_notes(),
        "e0 as (select word as sym, word as x from (select lpad(idx::varchar, 6, '0') as word from vocab))",
        *[f"e{m + 1} as materialized (select * from e{m} union all select 'M{m:05d}', a.x || '+' || b.x from top{m} join e{m} a on a.sym = l join e{m} b on b.sym = r)" for m in range(K)],
        f"m as (select rank, a.x as l, b.x as r from ({O.merges()}) join e{K} a on a.sym = l join e{K} b on b.sym = r)",
        final="""select rank::bigint as rank, l as "left", r as "right", false as is_ctrl from m union all select rank + (select count(*) from m), 'ctrl:' || l, 'ctrl:' || r, true from m""",
    ),
)
def double_merges(spark, sf_dir):
    return doubling.merge_rules(merges.train_one(note_words(spark, sf_dir)[0], K), spark)


@query("decode_roundtrip", O.statement(*O.notes(), final="select file_id, chunk_idx, pos, t, d, p, i, v from notes"))
def decode_roundtrip(spark, sf_dir):
    enc, rules, vocab = encoded_words(spark, sf_dir)
    return decoding.notes_of(enc.drop(*FIVE), vocab, rules)


# The sweep.
SWEEP_K = 4


@query("quant_sweep", O.statement(*O.sweep(SWEEP_K), final="select * from sweep"))
def quant_sweep(spark, sf_dir):
    return S.sweep(raw(spark, sf_dir), SWEEP_K)


@query("leverage", O.statement(*O.sweep(SWEEP_K), final="select factor, max(compression_factor) - min(compression_factor) as leverage, min_by(compression_factor, case when factor = 'velocity' then -sweep_value else sweep_value end) as at_finest, max_by(compression_factor, case when factor = 'velocity' then -sweep_value else sweep_value end) as at_coarsest from sweep group by factor"))
def leverage(spark, sf_dir):
    return S.leverage(S.sweep(raw(spark, sf_dir), SWEEP_K))


@query(
    "knee",
    O.statement(
        *O.sweep(SWEEP_K),
        "ends as (select *, first(sweep_value) over w as x0, first(compression_factor) over w as y0, last(sweep_value) over w as x1, last(compression_factor) over w as y1 from sweep window w as (partition by factor order by sweep_value rows between unbounded preceding and unbounded following))",
        "away as (select *, abs((y1 - y0) * (sweep_value - x0) - (x1 - x0) * (compression_factor - y0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as a from ends)",
        final="select factor, sweep_value as knee from away qualify row_number() over (partition by factor order by a desc, sweep_value) = 1",
    ),
)
def knee(spark, sf_dir):
    return S.knee(S.sweep(raw(spark, sf_dir), SWEEP_K))



@query("quant_sweep_full", None)
def quant_sweep_full(spark, sf_dir):
    return S.sweep(raw(spark, sf_dir), FULL)


BASELINE, CONSTRAINED = (O.statement(*O.sweep(SWEEP_K, standalone), final="select * from sweep") for standalone in (False, True))


@query(
    "baseline_against_standalone",
    f"select factor, sweep_value, a.compression_factor as baseline, b.compression_factor as constrained from ({BASELINE}) a full join ({CONSTRAINED}) b using (factor, sweep_value)",
)
def baseline_against_standalone(spark, sf_dir):
    return S.against(S.sweep(raw(spark, sf_dir), SWEEP_K), S.sweep(raw(spark, sf_dir), SWEEP_K, standalone=True))
