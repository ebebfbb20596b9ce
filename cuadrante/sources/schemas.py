"""Schemas of the JSON documents."""

CURRENT = (
    "degree:struct<code:string,name:string>,academic_year:string,semester:int,year:int,`group`:string,day:string,start_time:string,end_time:string,"
    "subject:struct<code:string,name:string>,subgroup:string,classroom:string,notes:array<string>"
)
SOURCE = "source:struct<file:string,page:int,raw_text:string>"
RECORD = f"struct<{CURRENT},{SOURCE},extraction:struct<degree_source:string,confidence:double,issues:array<string>>>"
RESULT = (
    "schema_version string, processed_at string, statistics struct<pdfs_found:int,pdfs_processed:int,pdfs_failed:int,accepted_records:int,rejected_records:int,records_with_warnings:int>, "
    f"files array<struct<file:string,pages:int,records:int,rejected:int>>, records array<{RECORD}>, rejected_records array<struct<reason:array<string>,record:{RECORD}>>, failed_files array<struct<file:string,error:string>>"
)
WORDS = "file string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
PAGES = "file string, page int, width double, height double, text string"
LEGACY_RECORD = "struct<source:struct<archivo:string,pagina:int>,academic_context:struct<titulacion:string,codigo_titulacion:string,curso_academico:string,cuatrimestre:string,curso:string,grupo:string>,schedule:struct<dia:string,hora_inicio:string,hora_fin:string>,subject:struct<codigo_asignatura:string,nombre:string,subgrupo:string,aula:string,texto_original:string>>"
LEGACY = f"schema_version string, processed_at string, input_file struct<path:string,name:string,total_pages:int>, standard_schedule array<{LEGACY_RECORD}>"
DEGREES = "id string, name string"
SUBJECTS = "id int, degree_id string, name string, grp string"
SESSIONS = "subject_id int, day string, start_time string, end_time string, classroom string"
_BOX = "struct<ord:int,text:string,x0:double,y0:double,x1:double,y1:double>"
DECODED = f"file string, page int, width double, height double, text string, words array<{_BOX}>, blocks array<{_BOX}>, error string"
