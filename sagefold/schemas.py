"""Schemas of stored and exchanged rows; nothing is inferred at run time."""

from __future__ import annotations

_ACTOR = "struct<login:string,__typename:string>"
_COMMENT = f"struct<id:string,url:string,body:string,createdAt:timestamp,diffHunk:string,author:{_ACTOR},authorAssociation:string,thumbsUp:int,thumbsDown:int>"

RAW_PR = (
    "number int, title string, body string, url string, state string, merged boolean, createdAt timestamp, updatedAt timestamp, mergedAt timestamp, "
    f"author {_ACTOR}, authorAssociation string, labels array<string>, files array<string>, filesTotal int, "
    f"reviews array<struct<id:string,url:string,state:string,body:string,submittedAt:timestamp,author:{_ACTOR},authorAssociation:string>>, "
    f"threads array<struct<id:string,path:string,line:int,isResolved:boolean,isOutdated:boolean,commentsTotal:int,comments:array<{_COMMENT}>>>, "
    f"comments array<{_COMMENT}>"
)

_WIRE_COMMENT = f"struct<id:string,url:string,body:string,createdAt:timestamp,diffHunk:string,author:{_ACTOR},authorAssociation:string,thumbsUp:struct<totalCount:int>,thumbsDown:struct<totalCount:int>>"
_INFO = "totalCount:int,pageInfo:struct<hasNextPage:boolean,endCursor:string>"

WIRE_PR = (
    "number int, title string, body string, url string, state string, merged boolean, createdAt timestamp, updatedAt timestamp, mergedAt timestamp, "
    f"author {_ACTOR}, authorAssociation string, labels struct<nodes:array<struct<name:string>>>, files struct<totalCount:int,nodes:array<struct<path:string>>>, "
    f"reviews struct<{_INFO},nodes:array<struct<id:string,url:string,state:string,body:string,submittedAt:timestamp,author:{_ACTOR},authorAssociation:string>>>, "
    f"reviewThreads struct<{_INFO},nodes:array<struct<id:string,path:string,line:int,isResolved:boolean,isOutdated:boolean,comments:struct<{_INFO},nodes:array<{_WIRE_COMMENT}>>>>>, "
    f"comments struct<{_INFO},nodes:array<{_WIRE_COMMENT}>>"
)

RULE_TEXT = "title:string,rule:string,rationale:string,kind:string,applies_when:string,paths:array<string>,languages:array<string>,bad_example:string,good_example:string,members:array<string>,opposing:array<string>"

#: Model output, which nothing guarantees.
EXTRACT_OUT = (
    "candidates array<struct<title:string,statement:string,rationale:string,category:string,kind:string,applies_when:string,paths:array<string>,"
    "languages:array<string>,bad_example:string,good_example:string,evidence:array<struct<ref:string,quote:string,outcome:string>>>>"
)
MERGE_OUT = f"rules array<struct<{RULE_TEXT}>>, discarded array<string>"
FOLD_OUT = f"assignments array<struct<candidate:string,rule:string,relation:string>>, new_rules array<struct<{RULE_TEXT}>>, discarded array<string>"
SCORE_OUT = "scores array<struct<id:string,tier:string,confidence:double,tier_reason:string,applies_when:string>>"

RESULT = "id string, text string, model string, stop_reason string, input_tokens long, output_tokens long, cache_read_input_tokens long, error string, completed_at timestamp"
REQUEST = "id string, system string, prompt string, schema string"
EVIDENCE = "rule_id string, side string, pos int, pr long, ref string, url string, author string, role string, date timestamp, quote string, outcome string, thumbs_up int, repo string"
