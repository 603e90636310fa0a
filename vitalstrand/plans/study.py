"""A study: cohort, splits, fitted references, vocabulary, tokens and windows over clinical tables.

Everything fitted (cut points, vocabulary) reads training persons only, by construction. Artefacts used
more than once are written to the shared folder the first time they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalstrand.config import CARDIAC_LOINC, StudyParams
from vitalstrand.operators import audit as au
from vitalstrand.operators import cohort as co
from vitalstrand.operators import scoring as sc
from vitalstrand.operators import signals as sg
from vitalstrand.operators import tokens as tk
from vitalstrand.operators import vocab as vo
from vitalstrand.operators import windows as wi
from vitalstrand.operators.joins import hot_keys, salted_join
from vitalstrand.operators.ranks import hash_sample
from vitalstrand.session import stage
from vitalstrand.sources.tables import ClinicalTables


# persons whose calendar rows (some 50 bytes each) may be sent to every executor
CALENDAR_BROADCAST = 200_000


class Study:
    """``records_of`` maps persons to their step and coded records by table, for tables that are dear to compute:
    each is then derived from it once instead of being computed at every use.
    """

    def __init__(
        self,
        tables: ClinicalTables,
        params: StudyParams = StudyParams(),
        lab_prefixes=CARDIAC_LOINC,
        records_of: Callable[[DataFrame], dict[str, DataFrame]] | None = None,
    ):
        self.tables = tables
        self.records_of = records_of
        self.params = params
        self.lab_prefixes = lab_prefixes

    def _together(self, *artefacts: str) -> None:
        """Submit the jobs of independent artefacts side by side, so small ones do not idle the cluster."""
        with ThreadPoolExecutor(len(artefacts)) as pool:
            list(pool.map(lambda name: getattr(self, name), artefacts))

    # --- cohort ------------------------------------------------------------------------------------

    def endpoint_plan(self) -> DataFrame:
        return co.expand_codeset(self.tables.concept, self.tables.codeset)

    @cached_property
    def endpoint_concepts(self) -> DataFrame:
        return stage(self.endpoint_plan(), "endpoints")

    @property
    def endpoint_ids(self) -> DataFrame:
        return co.endpoint_ids(self.endpoint_concepts)

    @cached_property
    def n_endpoints(self) -> int:
        return self.endpoint_concepts.count()

    def cohort_plan(self) -> DataFrame:
        t, p = self.tables, self.params
        return co.build_cohort(
            t.heart_rate_minute_level, t.condition_occurrence, t.person, p.min_span_days, p.min_age
        )

    @cached_property
    def _candidates(self) -> DataFrame:
        t, p = self.tables, self.params
        return stage(co.candidates(t.heart_rate_minute_level, t.person, p.min_span_days, p.min_age), "candidates")

    @cached_property
    def _candidate_records(self) -> dict[str, DataFrame]:
        return self.records_of(self._candidates)

    @cached_property
    def cohort(self) -> DataFrame:
        if self.records_of is None:
            return stage(self.cohort_plan(), "cohort")
        # candidates' records are joined once; which of them have a condition is read from there
        return stage(co.restrict(self._candidates, co.ehr_persons(self._candidate_records["condition_occurrence"])), "cohort")

    @cached_property
    def records(self) -> dict[str, DataFrame]:
        """Records of cohort persons by table; empty where the source tables are read as they are."""
        if self.records_of is None:
            return {}
        others = stage(self._candidates.join(self.cohort, "person_id", "left_anti").select("person_id"), "others")
        if others.isEmpty():
            return self._candidate_records
        return {name: df.join(others, "person_id", "left_anti") for name, df in self._candidate_records.items()}

    def source(self, table: str) -> DataFrame | None:
        """Records of at least the cohort."""
        return self.records.get(table, getattr(self.tables, table))

    def own(self, table: str) -> DataFrame:
        """Records of cohort persons."""
        return self.records[table] if table in self.records else self.members(getattr(self.tables, table))

    def endpoint_conditions(self) -> DataFrame:
        return co.endpoint_conditions(self.tables.condition_occurrence, self.endpoint_ids, self.n_endpoints)

    def events(self) -> DataFrame:
        """Endpoint events of cohort persons with their visit and the person's signal span."""
        mine = co.restrict(self.endpoint_conditions(), self.cohort)
        return co.cohort_events(co.events_with_visit(mine, self.tables.visit_occurrence), self.cohort)

    def events_after_start(self) -> DataFrame:
        return co.after_start(self.events())

    @cached_property
    def flagged(self) -> DataFrame:
        """Cohort with ``has_event``; only the event's day is needed, so visits are not joined."""
        self._together("cohort", "n_endpoints")
        dated = co.endpoint_conditions(self.source("condition_occurrence"), self.endpoint_ids, self.n_endpoints)
        mine = co.cohort_events(dated, self.cohort)
        return stage(co.flag_events(self.cohort, co.after_start(mine)), "flagged")

    @cached_property
    def splits(self) -> DataFrame:
        p = self.params
        return stage(co.stratified_split(self.flagged, p.split_seed, p.test_percent, p.val_percent), "splits")

    def persons(self, split: str) -> DataFrame:
        return self.splits.where(F.col("split") == split).select("person_id")

    @cached_property
    def n_persons(self) -> int:
        return self.splits.count()

    def members(self, df: DataFrame) -> DataFrame:
        """Rows of cohort persons."""
        return co.restrict(df, self.splits, n_ids=self.n_persons)

    def training(self, df: DataFrame) -> DataFrame:
        """Rows of training persons."""
        return co.restrict(df, self.persons("train"), n_ids=self.n_persons)

    # --- binned signals ----------------------------------------------------------------------------

    @cached_property
    def hr_sums(self) -> DataFrame:
        """Bin sums of cohort persons: minute data is read once for both the reference and the tokens."""
        return stage(sg.hr_bin_sums(self.members(self.tables.heart_rate_minute_level), self.params.hr_bin_minutes), "hr-sums")

    @cached_property
    def steps_by_day(self) -> DataFrame:
        return stage(sg.steps_daily(self.own("steps_intraday")), "steps-by-day")

    def wearables(self) -> DataFrame:
        """(stream, person_id, ts, v) of all binned signals."""
        hr = sg.hr_bins(self.hr_sums).withColumn("stream", F.lit("HR"))
        steps = self.steps_by_day.select("person_id", "ts", "v", F.lit("STEPS").alias("stream"))
        return hr.unionByName(steps)

    # --- fitted on training persons ----------------------------------------------------------------

    def reference_persons(self) -> DataFrame:
        train, n = self.persons("train"), self.params.reference_persons
        return train if n is None else stage(hash_sample(train, ["person_id"], n, self.params.reference_seed), "sample")

    def reference_rows(self) -> dict[str, DataFrame]:
        """Binned rows that the cut points are fitted on."""
        sample = self.reference_persons()
        hr = co.restrict(self.hr_sums, sample, n_ids=self.n_persons)
        steps = co.restrict(self.steps_by_day, sample, n_ids=self.n_persons)
        return {"hr_cuts": hr, "steps_cuts": steps}

    def reference(self) -> DataFrame:
        p = self.params
        _ = self.n_persons  # both artefacts below read the splits
        self._together("hr_sums", "steps_by_day")
        hr, steps = self.reference_rows().values()
        values = sg.hr_reference(hr, p.hr_bin_minutes, p.pool_hours, p.reference_rows, p.reference_seed)
        return values.unionByName(steps.select(F.lit("STEPS").alias("stream"), "v"))

    @cached_property
    def cuts(self) -> DataFrame:
        return stage(sg.decile_cuts(self.reference()), "cuts")

    def code_sources(self) -> tuple[DataFrame, dict[str, DataFrame]]:
        """Coded records of at least the cohort and the lookups of their streams."""
        t = self.tables
        sources = [
            ("DX10", self.source("condition_occurrence"), "condition_source_concept_id"),
            ("PX10", self.source("procedure_occurrence"), "procedure_concept_id"),
        ]
        concepts = {"DX10": vo.dx_concepts(t.concept), "PX10": vo.px_concepts(t.concept)}
        if t.drug_exposure is not None and t.concept_ancestor is not None:
            sources.append(("MED", self.source("drug_exposure"), "drug_concept_id"))
            concepts["MED"] = vo.med_concepts(t.concept, t.concept_ancestor)
        if t.measurement is not None:
            sources.append(("LAB", self.source("measurement"), "measurement_concept_id"))
            concepts["LAB"] = vo.lab_concepts(t.concept, self.lab_prefixes)
        return vo.coded_records(sources), concepts

    def vocab_rows(self) -> DataFrame:
        """Coded records that the vocabulary is fitted on."""
        return self.training(self.code_sources()[0])

    @cached_property
    def _token_counts(self) -> DataFrame:
        return stage(vo.count_tokens(self.vocab_rows(), vo.streams_of(self.code_sources()[1])), "token-counts")

    def token_counts(self) -> DataFrame:
        """(stream, token, n) over the coded records of training persons, counted once."""
        return self._token_counts

    def _fingerprints(self, rows: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [au.fingerprint(df, name) for name, df in rows.items()])

    @cached_property
    def fit_log(self) -> DataFrame:
        """Fingerprint of the rows behind each fitted artefact, to be kept beside it."""
        return stage(self._fingerprints(self.reference_rows() | {"vocab": self.vocab_rows()}), "fit-log")

    def leakage(self, fit_log: DataFrame | None = None) -> DataFrame:
        """Audit of a log (this study's by default) against the rows of persons in the training split, and no others."""
        train = self.splits.where(F.col("split") == "train").select("person_id").distinct()
        allowed = {"hr_cuts": self.hr_sums, "steps_cuts": self.steps_by_day}
        if self.params.reference_persons is not None:
            sample = self.reference_persons()
            allowed = {name: df.join(sample, "person_id", "left_semi") for name, df in allowed.items()}
        allowed["vocab"] = self.code_sources()[0]
        may = self._fingerprints({name: df.join(train, "person_id", "left_semi") for name, df in allowed.items()})
        return au.leakage(self.fit_log if fit_log is None else fit_log, may)

    @cached_property
    def vocab(self) -> DataFrame:
        return stage(vo.build_vocab(self.token_counts()), "vocab")

    @cached_property
    def id_space(self) -> int:
        """Highest id of the vocabulary plus one: ids a model must hold."""
        return self.vocab.agg(F.max("tid")).head()[0] + 1

    @cached_property
    def code_ids(self) -> DataFrame:
        """(stream, concept_id, token, tid) for the streams the windows read."""
        concepts = {"DX10": vo.dx_concepts(self.tables.concept), "PX10": vo.px_concepts(self.tables.concept)}
        return stage(vo.with_ids(vo.streams_of(concepts), self.vocab), "code-ids")

    def ids_of(self, stream: str) -> DataFrame:
        return self.code_ids.where(F.col("stream") == stream).drop("stream")

    # --- tokens ------------------------------------------------------------------------------------

    def deciles(self) -> DataFrame:
        return sg.encode_deciles(self.wearables(), self.cuts)

    def hr_deciles(self) -> DataFrame:
        return self.deciles().where(F.col("stream") == "HR").drop("stream")

    def steps_deciles(self) -> DataFrame:
        return self.deciles().where(F.col("stream") == "STEPS").drop("stream")

    def condition_tokens(self) -> DataFrame:
        return tk.coded_events(self.own("condition_occurrence"), "condition_start_date", "condition_source_concept_id", self.ids_of("DX10"))

    def procedure_tokens(self) -> DataFrame:
        return tk.coded_events(self.own("procedure_occurrence"), "procedure_date", "procedure_concept_id", self.ids_of("PX10"))

    def medication_tokens(self) -> DataFrame:
        t = self.tables
        lookup = vo.with_ids(vo.med_concepts(t.concept, t.concept_ancestor).select("concept_id", "token"), self.vocab)
        return tk.coded_events(self.own("drug_exposure"), "drug_exposure_start_date", "drug_concept_id", lookup)

    def ehr_tokens(self) -> DataFrame:
        sources = [
            ("DX10", "condition_occurrence", "condition_start_date", "condition_source_concept_id"),
            ("PX10", "procedure_occurrence", "procedure_date", "procedure_concept_id"),
        ]

        def coded(read) -> DataFrame:
            dated = [
                read(table).select("person_id", F.col(day).alias("day"), F.lit(stream).alias("stream"), F.col(key).alias("concept_id"))
                for stream, table, day, key in sources
            ]
            return dated[0].unionByName(dated[1])

        # hot concepts are sought in the source tables, which is cheaper than in the members' joined rows
        hot = hot_keys(coded(self.source), "concept_id")
        records = salted_join(coded(self.own), self.code_ids, ["stream", "concept_id"], hot, ["person_id", "day"], by="concept_id")
        return tk.ehr_tokens(records.select("person_id", F.col("day").cast("timestamp").alias("ts"), "token", "tid"))

    def tokens(self) -> DataFrame:
        _ = self.n_persons  # both artefacts below read the splits
        self._together("cuts", "code_ids")
        return tk.all_tokens(
            tk.wearable_tokens(self.deciles()),
            self.ehr_tokens(),
        )

    # --- windows -----------------------------------------------------------------------------------

    def calendar(self) -> DataFrame:
        """One row per person; few enough persons are broadcast, so packed days move only once."""
        p = self.params
        rows = wi.person_calendar(self.splits, p.window_days, p.lookahead_days, p.stride_days)
        return F.broadcast(rows) if self.n_persons <= CALENDAR_BROADCAST else rows

    def anchors(self) -> DataFrame:
        return wi.window_anchors(self.calendar())

    def event_days(self) -> DataFrame:
        dated = co.endpoint_conditions(self.own("condition_occurrence"), self.endpoint_ids, self.n_endpoints)
        days = dated.select("person_id", F.col("condition_start_date").alias("event_day"))
        if self.params.incident_only:
            return days.groupBy("person_id").agg(F.min("event_day").alias("event_day"))
        return days

    def positives(self) -> DataFrame:
        return wi.positive_windows(self.event_days(), self.calendar(), self.params.lookahead_days)

    def window_tokens(self) -> DataFrame:
        return wi.window_tokens(self.tokens(), self.calendar(), self.params.window_days)

    def sequences(self) -> DataFrame:
        p = self.params
        packs = wi.day_packs(self.tokens(), p.max_len)
        return wi.window_sequences(packs, self.calendar(), p.window_days, p.max_len, p.calendar_positions)

    def windows(self) -> DataFrame:
        """Labelled sequences: (person_id, end_date, split, input_ids, positions, n_tokens, label)."""
        return wi.with_labels(self.sequences(), self.positives())

    def scored(self, weights: DataFrame, bias: float) -> DataFrame:
        """Labelled scores (person_id, end_date, split, label, logit); only windows that are cut are built as sequences."""
        p, tokens = self.params, stage(self.tokens(), "tokens")
        spans = stage(sc.score_spans(tokens, self.calendar(), weights, bias, p.window_days), "spans")
        whole = spans.where(F.col("n_tokens") <= p.max_len).drop("n_tokens")
        cut = spans.where(F.col("n_tokens") > p.max_len).select(*wi.KEYS)
        if not cut.isEmpty():
            packs = wi.day_packs(tokens.join(cut.select("person_id").distinct(), "person_id", "left_semi"), p.max_len)
            built = wi.window_sequences(packs, self.calendar(), p.window_days, p.max_len, p.calendar_positions, cut)
            whole = whole.unionByName(sc.score_windows(built, weights, bias))
        return wi.with_labels(whole, self.positives())

    def window_index(self) -> DataFrame:
        """Labelled windows without arrays: (person_id, end_date, split, n_tokens, label)."""
        p = self.params
        sizes = wi.window_sizes(self.tokens(), self.calendar(), p.window_days, p.max_len)
        return wi.with_labels(sizes, self.positives())
