"""pulsegrid: Spark jobs for sampled optical-pulse recordings.

A recording is a DataFrame keyed by ``(session_id, sample_idx)``; ``sample_idx``
is dense and starts at 0 in every session.  Operators never put a whole session
in one task: they work on fixed-size *segments* of a session plus a halo.
"""
