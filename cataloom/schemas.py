"""Schemas of the catalog's tables."""

LINK = "struct<from_output:string,to_input:string,kind:string,from_logic_id:string,link_explanation:string,in_graph:boolean>"
FIELD = "struct<name:string,type:string,allowedValues:array<string>>"
LOGIC = (
    "name string, purpose string, spec string, code_block string, code_file string, code_lines array<int>, code_function string, example string, "
    f"dmn_hit_policy string, dmn_inputs array<{FIELD}>, dmn_outputs array<{FIELD}>, dmn_table string, timestamp string, id string, owner string, "
    f"component string, kind string, links array<{LINK}>, rootDir string, sourcePath string, category string, business_area string, "
    "category_explanation string, archived boolean, ai_categorized boolean"
)
HIERARCHY = "struct<topId:string,name:string,description:string,useGraph:boolean,isIgnored:boolean>"
MODEL = f"id string, name string, description string, status string, logicIds array<string>, hierarchies array<{HIERARCHY}>"
CATEGORY = "id string, name string, groupId string, team string, type string, kind string, isGroup boolean"
GROUP = "id string, name string, archived boolean, businessRelevant boolean, categories array<string>"

#: Old column names and what they are called now.
RENAMED = {
    "rule_name": "name", "rule_purpose": "purpose", "rule_spec": "spec", "rule_category": "category", "rule_id": "id",
    "from_step_id": "from_logic_id", "fromLogicId": "from_logic_id", "businessLogicIds": "logicIds", "topDecisionId": "topId",
}
#: Fields that links must have.
REQUIRED_LINK_FIELDS = ("from_output", "to_input", "kind", "from_logic_id")
