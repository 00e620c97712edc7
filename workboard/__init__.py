"""workboard — work-request and project-portfolio operators on Spark DataFrames.

Entry points (all DataFrame in → DataFrame out, native Column expressions, no UDFs):

* ``workboard.session.get_session`` — session settings (UTC, ANSI, AQE, UI off); shared folders for streams.
* ``workboard.sources.tables`` — typed reads, ``with_ids`` / ``max_id`` (contiguous ids), ``conform``,
  ``append`` / ``replace_partitions`` / ``write_table`` sinks.
* ``workboard.operators.intake`` — JSON and form intake (``erp_requests``, ``general_requests``, ``infra_requests``,
  ``notes``, ``projects``, ``tasks``), ``split_valid``, ``create``, ``resolve_project_names``.
* ``workboard.operators.search`` — list projections, optional filters, text search, top-k, key lookups, feed.
* ``workboard.operators.changes`` — ``apply_patch``, ``upsert``, deletes, cascade, outcomes.
* ``workboard.operators.portfolio`` / ``releases`` / ``activity`` / ``audit`` / ``attachments`` / ``directory``.
* ``workboard.streaming.apply`` — stream intake and change logs (``intake_stream``, ``change_log_stream``).
"""

__version__ = "0.1.0"
