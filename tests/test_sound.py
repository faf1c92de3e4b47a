"""Every analysis over files or attachments refuses an archive in which one row breaks a rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadloom import queries
from threadloom.plans import views

#: Queries that look at no evidence: they judge names and folders themselves, or the rows are other tables.
OF_FILES = (
    "evidence_by_asset_date", "source_facts", "date_density", "exact_relations", "relation_counts", "state_counts", "candidate_bands", "adjacent_relations", "source_contributions", "relations_by_media_type", "match_census",
    "token_curve", "ambiguity", "continuity", "namespaces", "date_populations", "assignment_groups", "sliding_unions", "feasibility", "gate_pairs", "pair_states", "numbered_pairs", "determinacy", "dilution", "source_overlap", "excluded_attachments",
)


@pytest.mark.parametrize("name", OF_FILES)
def test_a_wrong_date_is_refused(spark, small, monkeypatch, name):
    def planted(spark, sf_dir, *dates):
        files = views.media_files(spark, sf_dir, *dates)
        bad = F.col("file_id") == files.where("file_date is not null and size > 0").agg(F.max("file_id")).first()[0]
        return files.withColumn("file_date", F.when(bad, F.date_add("file_date", 1)).otherwise(F.col("file_date")))

    monkeypatch.setattr(queries, "media_files", planted)
    with pytest.raises(Exception, match="marker_differs_from_date"):
        queries.QUERIES[name](spark, small).collect()


@pytest.mark.parametrize("name", ["exact_relations", "relation_counts", "source_contributions", "match_census", "assignment_groups", "message_patterns", "pair_states", "excluded_attachments"])
def test_an_attachment_without_a_date_is_refused(spark, small, monkeypatch, name):
    def planted(of):
        def run(spark, sf_dir, *dates):
            a = of(spark, sf_dir, *dates)
            return a.withColumn("message_date", F.when(F.col("attachment_id") == a.agg(F.max("attachment_id")).first()[0], None).otherwise(F.col("message_date")))

        return run

    monkeypatch.setattr(queries, "attachments", planted(views.attachments))
    monkeypatch.setattr(queries, "sent_attachments", planted(views.sent_attachments))
    with pytest.raises(Exception, match="attachment_without_message_date"):
        queries.QUERIES[name](spark, small).collect()
