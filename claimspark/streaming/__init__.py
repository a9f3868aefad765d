"""Streaming: per-claim rule flags on an incoming claims stream."""

from claimspark.streaming.flags import flag_claims, start_flagging  # noqa: F401
