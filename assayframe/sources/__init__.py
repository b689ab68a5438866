from assayframe.sources.session import get_session, scratch_root, settle  # noqa: F401
