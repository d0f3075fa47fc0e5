"""Schemas of the durable tables."""

from pyspark.sql import types as T

_s, _l, _b = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


WINDOW = T.ArrayType(_struct(turn=_l, type=_s, excerpt=_s))
INCIDENT = _struct(incident_id=_s, session_id=_s, project=_s, ts=_s, signal_type=_s, implicated_artifact=_s, candidates=T.ArrayType(_s), window=WINDOW, confidence=_s, detail=_s)
#: What is read of a content block; objects, as a call's input, stay JSON text.
BLOCK = _struct(type=_s, id=_s, name=_s, input=_s, tool_use_id=_s, is_error=_s, text=_s)
USE = _struct(tuid=_s, tool=_s, file_path=_s, rd_offset=_s, rd_limit=_s, subagent_type=_s, input_str=_s)
RESULT = _struct(tuid=_s, is_error=_b)
#: A parsed line, before its turn is known; calls of assistants, results and texts of users.
RECORD = _struct(type=_s, session_id=_s, uuid=_s, ts=_s, cwd=_s, is_sidechain=_b, excerpt=_s, content_kind=_s, uses=T.ArrayType(USE), results=T.ArrayType(RESULT), texts=T.ArrayType(_s), total_lines=_l, filename=_s)
PROPOSAL = _struct(id=_s, implicated_artifact=_s, signal_type=_s, fix_type=_s, evidence=T.ArrayType(_s), diagnosis=_s, proposed_change=_s, confidence=_s, reason_log=_s)
LEDGER = _struct(path=_s, id=_s, artifact=_s, signal_type=_s, outcome_raw=_s, outcome_or_open=_s, pr_url=_s, content=_s)
PLAN = _struct(proposal_id=_s, group_id=_s, repo_root=_s, file_path=_s, section=_s, owner=_s, branch_name=_s, base=_s, status=_s, reason=_s, supersedes=_s)
#: What the caller knows of an artifact's path: its real path, whether it exists, and its repository.
TARGET_FACT = _struct(path=_s, real_path=_s, exists=_b, repo_root=_s, origin_url=_s, base=_s)
#: What exists: a path and where it leads; null for a link that leads nowhere.
LINK = _struct(path=_s, real_path=_s)
#: A checkout, and the main one where it is a linked one of a repository.
REPO = _struct(root=_s, main_root=_s, origin_url=_s, base=_s)
OPEN_PR = _struct(number=_l, title=_s, headRefName=_s, url=_s)
PR_STATE = _struct(url=_s, state=_s)
#: The same with the time at which a pull request was closed.
PR_CLOSED = _struct(url=_s, state=_s, closed_at=_s)
EDITOR_RESULT = _struct(applied=_b, files_changed=T.ArrayType(_s), summary=_s, reason=_s)
