"""Types of the engine's tables. A value is a tagged union: kind names the one payload that is set."""

from __future__ import annotations

from pyspark.sql import types as T

RATIONAL = "struct<numerator:bigint,denominator:bigint>"
VALUE = f"struct<kind:string,s:string,i:bigint,d:double,r:{RATIONAL},rl:array<{RATIONAL}>,b:binary,c:struct<latitude:double,longitude:double>>"
PROVENANCE = "struct<container:string,namespace:string,path:string,offset_start:bigint,offset_end:bigint,notes:array<string>>"
ENTRY = f"struct<ord:int,namespace:string,tag_id:string,tag_name:string,value:{VALUE},provenance:{PROVENANCE},notes:array<string>>"
NODE = "struct<ord:int,kind:string,label:string,offset_start:bigint,offset_end:bigint,parent_label:string>"
ISSUE = "struct<ord:int,severity:string,code:string,message:string,offset:bigint,context:string>"
DECODED = f"status string, error_message string, container string, nodes array<{NODE}>, entries array<{ENTRY}>, issues array<{ISSUE}>"
SIDE = f"struct<namespace:string,tag_id:string,tag_name:string,value:{VALUE},provenance:{PROVENANCE}>"


def schema_of(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)
