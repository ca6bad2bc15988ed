"""Schemas of observations: what analyzers write and rules read. Every field is nullable; missing means not observed."""

from __future__ import annotations

from pyspark.sql import types as T

IOC = "struct<urls:array<string>,domains:array<string>,ips:array<string>,emails:array<string>>"
FILE = "struct<name:string,size:bigint,family:string,label:string,extension:string,extension_mismatch:string,extension_is_dangerous:boolean,filename_flags:array<string>,entropy:double,head_hex:string,md5:string,sha1:string,sha256:string>"
VBA = f"struct<macros:array<struct<stream:string,name:string,lines:int,code:string>>,auto_exec:array<string>,suspicious_calls:array<struct<keyword:string,meaning:string>>,total_macro_lines:int,deobfuscated:array<string>,raw_iocs:{IOC}>"
PACKAGE = "struct<entries:array<struct<name:string,size:bigint,compressed:bigint>>,external_targets:array<struct<part:string,type:string,target:string>>,remote_template:string,embedded_objects:array<string>,has_vba_project:boolean>"
STRUCTURE = "struct<parsed:boolean,version:string,encrypted:boolean,pages:int,javascript:array<string>,embedded_files:array<struct<name:string,size:bigint,entropy:double>>,open_action:string,launch_actions:array<string>,uris:array<string>,page_actions:array<struct<page:int,key:string,value:string>>>"
ENTRY = "struct<name:string,size:bigint,compressed:bigint,encrypted:boolean,extension:string,is_dir:boolean,is_link:boolean>"
CHILD = "struct<name:string,depth:int,family:string,label:string,size:bigint,sha256:string,entropy:double,extension_mismatch:string,filename_flags:array<string>,dangerous:boolean>"
PE = "struct<parsed:boolean,sections:array<struct<name:string,virtual_size:bigint,raw_size:bigint,entropy:double,writable:boolean,executable:boolean,write_and_execute:boolean,virtual_oversize:boolean>>,packer_sections:array<string>,imports:array<string>,capabilities:map<string,array<string>>,import_table_stripped:boolean,resources:array<struct<type:string,size:bigint,entropy:double,looks_executable:boolean>>,overlay:struct<offset:bigint,size:bigint,entropy:double,looks_executable:boolean>,digitally_signed:boolean,timestamp_implausible:boolean,compile_time:string,imphash:string,entry_outside_code:boolean>"
STATIC = (
    f"struct<engine:string,vba:{VBA},dde:struct<found:boolean,links:array<string>,output:string>,ole_objects:struct<output:string,found_urls:array<string>>,metadata:string,streams:string,package:{PACKAGE},"
    "xlm_biff8_sheets:array<struct<name:string,type:string,visibility:string,hidden:boolean>>,xlm_macros_indicated:boolean,embedded_executables:array<struct<offset:bigint,machine_bytes:string>>,"
    f"structure:{STRUCTURE},keywords:map<string,struct<count:int,meaning:string>>,javascript:array<string>,javascript_present:boolean,object_streams_inflated:int,incremental_updates:int,"
    f"listing:struct<format:string,encrypted:boolean,compression_ratio:double,total_uncompressed:bigint,entry_count:int>,entries:array<{ENTRY}>,dangerous_entries:array<struct<name:string,extension:string>>,decoy_names:array<struct<name:string,reason:string>>,password_protected:boolean,path_traversal:array<string>,zip_bomb_suspected:boolean,children:array<{CHILD}>,max_depth:int,"
    "jar:struct<manifest:map<string,string>,main_class:string,class_count:int,suspicious_class_names:array<struct<class:string,matched_keywords:array<string>>>,signed:boolean>,"
    f"pe:{PE},elf:struct<parsed:boolean,class:string,endian:string,type:string,machine:int>,deobfuscated:struct<fromcharcode:array<string>,hex_escapes:array<string>,reversed:array<string>,concatenated:array<string>>,base64_blobs:array<struct<encoded_length:int,encoding:string,looks_like_text:boolean,looks_like_pe:boolean,entropy:double,decoded_preview:string>>,"
    f"single_line_obfuscation:boolean,longest_line:int,line_count:int,length:int,entropy:double,powershell_indicators:array<struct<flag:string,meaning:string>>,strings:array<string>,file_iocs:{IOC}>"
)
DYNAMIC = f"struct<executed:boolean,engine:string,reason:string,error:string,exit_code:int,timed_out:boolean,duration_seconds:double,trace_lines:bigint,processes:array<struct<path:string,command:string>>,process_count:int,files_written:array<string>,files_deleted:array<string>,files_renamed:array<struct<from:string,to:string>>,made_executable:array<struct<path:string,mode:string,makes_executable:boolean>>,tcp_connects:array<struct<ip:string,port:int,failed:boolean>>,unix_sockets:array<string>,anonymous_executables:array<string>,persistence_paths:array<struct<path:string,meaning:string>>,lolbins_invoked:array<string>,extracted_urls:array<string>,resources:array<struct<name:string,size:bigint,entropy:double,looks_like_pe:boolean,sha256:string>>,stdout_iocs:{IOC},output:string,iocs:{IOC}>"
FLOW_FIELDS = "ts:string,src:string,kind:string,qname:string,qtype:string,answer:string,method:string,host:string,path:string,scheme:string,user_agent:string,headers:map<string,string>,body_len:int,body_preview:string,target:string,dport:int,bytes:int,preview:string,error:string"
FLOW = f"struct<{FLOW_FIELDS}>"
CONNECT = "struct<ip:string,port:int,failed:boolean>"
NETWORK = f"struct<dns_queries:array<{FLOW}>,http_requests:array<{FLOW}>,tcp_sessions:array<{FLOW}>,connect_attempts:array<{CONNECT}>,contacted_hosts:array<string>>"
OBSERVATIONS = f"file:{FILE},static:{STATIC},dynamic:{DYNAMIC},network:{NETWORK},iocs:{IOC}"
ERRORS = "array<struct<stage:string,error:string>>"
SIGNATURE = "struct<id:string,name:string,severity:int,description:string,evidence:array<string>>"


def ddl(fields: str) -> T.StructType:
    return T._parse_datatype_string(f"struct<{fields}>")  # type: ignore[attr-defined]
