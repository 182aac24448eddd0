"""Grammars and scanners of the five languages whose files are checked for syntax.

Operators between operands need no precedence to be recognised, so expressions are operand, operator, operand.
JavaScript and TypeScript are dialects of one grammar with two start rules. Line ends that may end a JavaScript
statement are tokens of class NL.
"""

from __future__ import annotations

import re
import unicodedata

from .gll import BASE, CLOSER, Folder, Grammar, Reject

ECMA = r"""
JsModule = Item*
JsScript = Stmt*
TsModule = TItem*
Item = 'import' ImportRest Semi | 'import' (Expr) MoreExpr Semi | 'import' '.' Name MoreExpr Semi | Export | Stmt
ImportRest = STR ImportWith? | ImportClause 'from' STR ImportWith?
ImportWith = 'with' {ObjBody}
ImportClause = Id | Id ',' Braced | Id ',' Star | Braced | Star
Star = '*' 'as' Id
Braced = {Specs}
Specs = SpecList? NL?
SpecList = Spec | Spec ',' | Spec ',' SpecList
Spec = ModName | ModName 'as' ModName | 'type' ModName | 'type' ModName 'as' ModName
ModName = Name | STR
Export = 'export' ExportRest
ExportRest = Braced Semi | Braced 'from' STR ImportWith? Semi | '*' 'from' STR ImportWith? Semi | '*' 'as' ModName 'from' STR ImportWith? Semi | 'default' FuncAny | 'default' ClassAny | 'default' Expr Semi | VarDecl | FuncDecl | ClassDecl
FuncAny = 'async'? 'function' '*'? Id? FuncTail
FuncTail = (Params) {Body}
Body = Stmt*
Stmt = {Body} | VarDecl | FuncDecl | ClassDecl | If | For | While | Do | Switch | Try | 'return' Expr? Semi | 'throw' Expr Semi | 'break' Id? Semi | 'continue' Id? Semi | 'debugger' Semi | Id ':' NL? Stmt | 'with2' (Expr) NL? Stmt | ';' | NL | Expr Semi
Semi = ';' | NL
VarDecl = VarKind Binding Bindings Semi
VarKind = 'let' | 'const' | 'var' | 'using'
Bindings = | ',' Binding Bindings
Binding = Target Init?
Init = '=' NoComma
Target = Id | {ObjPat} | [ArrPat]
ObjPat = PropPats? NL?
PropPats = PropPat | PropPat ',' | PropPat ',' PropPats | '...' Target
PropPat = Id Init? | PropName ':' Target Init?
ArrPat = | ',' ArrPat | '...' Target | Target Init? | Target Init? ',' ArrPat
FuncDecl = 'async'? 'function' '*'? Id FuncTail
Params = ParamList?
ParamList = Param | Param ',' | Param ',' ParamList | '...' Target
Param = Decorator* Target Init?
If = 'if' (Expr) NL? Stmt Else?
Else = 'else' NL? Stmt
For = 'for' 'await'? (ForHead) NL? Stmt
ForHead = ForInit? ';' Expr? ';' Expr? | VarKind Target 'of' NoComma | VarKind Target 'in' Expr | Operand 'of' NoComma | Operand 'in' Expr
ForInit = VarKind Binding Bindings | Expr
While = 'while' (Expr) NL? Stmt
Do = 'do' NL? Stmt 'while' (Expr) Semi?
Switch = 'switch' (Expr) {Cases}
Cases = Case*
Case = 'case' Expr ':' Stmt* | 'default' ':' Stmt* | NL
Try = 'try' {Body} Handler
Handler = NL? Catch | NL? Finally | NL? Catch NL? Finally
Catch = 'catch' {Body} | 'catch' (Target) {Body}
Finally = 'finally' {Body}
ClassDecl = Decorator* 'class' Id Heritage? {ClassBody}
ClassAny = Decorator* 'class' Id? Heritage? {ClassBody}
Decorator = '@' Id DecoratorRest* NL? | '@' (Expr) NL?
DecoratorRest = '.' Name | (Args)
Heritage = 'extends' Operand
ClassBody = Member*
Member = ';' | NL | Decorator* 'static'? MemberRest | 'static' {Body}
MemberRest = 'async'? '*'? PropName FuncTail | Accessor PropName FuncTail | PropName Init? Semi | 'accessor' PropName Init? Semi
Accessor = 'get' | 'set'
PropName = Name | STR | NUM | [NoComma] | PRIVATE
Expr = NoComma | NoComma ',' Expr
NoComma = Arrow | 'yield' | 'yield' '*'? NoComma | Unary MoreExpr
MoreExpr = | BinOp NoComma | '?' NoComma ':' NoComma
BinOp = '=' | ASSIGN | OP | '+' | '-' | '*' | '/' | '<' | '>' | 'in' | 'instanceof' | '>>'
Unary = Operand | Pre Unary | Operand '++' | Operand '--'
Pre = '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'
Operand = Primary Post*
Post = '.' Name | '.' PRIVATE | '?.' Name | '?.' PRIVATE | '?.' (Args) | '?.' [Expr] | (Args) | [Expr] | `Parts`
Primary = Id | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | `Parts` | (Expr) | [ArrBody] | {ObjBody} | FuncAny | ClassAny | 'new' Operand | 'new' '.' 'target' | 'import' (Args) | 'import' '.' Name | PRIVATE
Parts = Part*
Part = (Expr)
Args = ArgList?
ArgList = Arg | Arg ',' | Arg ',' ArgList
Arg = NoComma | '...' NoComma
ArrBody = | ',' ArrBody | Arg | Arg ',' ArrBody
ObjBody = Props? NL?
Props = Prop | Prop ',' | Prop ',' Props
Prop = Id | Id Init | PropName ':' NoComma | '...' NoComma | 'async'? '*'? PropName FuncTail | Accessor PropName FuncTail
Arrow = 'async'? Id '=>' ArrowBody | 'async'? (Params) '=>' ArrowBody
ArrowBody = {Body} | NoComma
Id = ID | SOFT | 'as' | 'async' | 'from' | 'of' | 'get' | 'set' | 'static' | 'type' | 'accessor' | 'let' | 'yield' | 'await' | 'using' | 'is' | 'target'
Name = Id | KEY | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | 'export' | 'with' | 'with2' | 'default' | 'function' | 'return' | 'throw' | 'break' | 'continue' | 'debugger' | 'const' | 'var' | 'if' | 'else' | 'for' | 'in' | 'while' | 'do' | 'switch' | 'case' | 'try' | 'catch' | 'finally' | 'class' | 'extends' | 'instanceof' | 'typeof' | 'void' | 'delete' | 'new' | 'enum'
TItem = 'import' TImportRest Semi | 'import' 'type' TImportRest Semi | 'import' 'type'? Id '=' TExpr Semi | 'import' (TExpr) TMore Semi | 'import' '.' Name TMore Semi | TExport | TStmt
TImportRest = STR TImportWith? | ImportClause 'from' STR TImportWith?
TImportWith = 'with' {TObjBody}
TExport = 'export' TExportRest
TExportRest = 'type'? Braced Semi | 'type'? Braced 'from' STR Semi | 'type'? '*' 'from' STR Semi | 'type'? '*' 'as' ModName 'from' STR Semi | 'default' TFuncAny | 'default' TClassAny | 'default' 'abstract' TClassAny | 'default' TDeclOnly | 'default' TExpr Semi | '=' TExpr Semi | 'as' 'namespace' Id Semi | TVarDecl | TFuncDecl | TClassDecl | TDeclOnly | 'import' Id '=' TExpr Semi
TDeclOnly = TInterface | TAlias | TEnum | TNamespace | 'declare' TAmbient
TAmbient = TVarDecl | TFuncDecl | TClassDecl | TInterface | TAlias | TEnum | TNamespace | 'global' {TBody}
TInterface = 'interface' Id TParams? TExtends? {TMembers}
TExtends = 'extends' TRefs
TRefs = TRef | TRef ',' TRefs
TRef = QName TArgs?
QName = Id QRest*
QRest = '.' Name
TArgs = '<' TypeList '>'
TypeList = Type | Type ',' | Type ',' TypeList
TParams = '<' TParamList '>'
TParamList = TParam | TParam ',' | TParam ',' TParamList
TParam = TParamMod* Id TConstraint? TDefault?
TParamMod = 'const' | 'in' | 'out'
TConstraint = 'extends' Type
TDefault = '=' Type
TAlias = 'type' Id TParams? '=' Type Semi
TEnum = 'const'? 'enum' Id {EnumBody}
EnumBody = EnumList? NL?
EnumList = EnumOne | EnumOne ',' | EnumOne ',' EnumList
EnumOne = EnumName | EnumName '=' TNoComma
EnumName = Name | STR
TNamespace = TNsWord TNsName {TNsBody} | TNsWord STR Semi
TNsWord = 'namespace' | 'module'
TNsName = QName | STR
TNsBody = TItem*
TMembers = TMember*
TMember = ';' | ',' | NL | TParams? (TFnParams) TRet? TSep | 'new' TParams? (TFnParams) TRet? TSep | TMod* TKey '?'? TAnn? TSep | TMod* TKey '?'? TParams? (TFnParams) TRet? TSep | Accessor TKey (TFnParams) TRet? TSep | TMod* [TIndex] '?'? TAnn TSep | TMod* [TMapped] TMapOpt? TAnn TSep
TMapOpt = '?' | '+' '?' | '-' '?'
TSep = ';' | ',' | NL
TMod = 'readonly' | 'static' | '+' | '-'
TKey = Name | STR | NUM | [TNoComma]
TIndex = Id ':' Type
TMapped = Id 'in' Type TAs?
TAs = 'as' Type
TAnn = ':' Type
TRet = ':' Type
Type = TLead? TUnit TypeRest
TypeRest = | TBin Type | 'extends' Type '?' Type ':' Type
TLead = '|' | '&'
TBin = '|' | '&'
TUnit = TBase TPost*
TPost = [TIdx]
TIdx = | Type
TBase = TParams? (TFnParams) '=>' Type | 'abstract'? 'new' TParams? (TFnParams) '=>' Type | (Type) | QName TArgs? | {TMembers} | [TTuple] | STR | NUM | '-' NUM | `TParts` | 'typeof' TTypeof | 'keyof' TUnit | 'readonly' TUnit | 'unique' TUnit | 'infer' Id TConstraint? | 'this' | 'void' | 'null' | 'true' | 'false' | TPredName 'is' Type | 'asserts' TPredName | 'asserts' TPredName 'is' Type | 'import' (Type) QRest* TArgs?
TTypeof = QName TArgs? | 'import' (Type) QRest*
TPredName = Id | 'this'
TTuple = TTupleList?
TTupleList = TTupleOne | TTupleOne ',' | TTupleOne ',' TTupleList
TTupleOne = Type '?'? | '...' Type | Name '?'? ':' Type | '...' Name ':' Type
TParts = TPart*
TPart = (Type)
TFnParams = TFnParamList?
TFnParamList = TFnParam | TFnParam ',' | TFnParam ',' TFnParamList
TFnParam = TDecorator* TParMod* '...'? TTarget '?'? TAnn? TInit? | 'this' TAnn
TParMod = 'public' | 'private' | 'protected' | 'readonly' | 'override'
TTarget = Id | {TObjPat} | [TArrPat]
TObjPat = TPropPats? NL?
TPropPats = TPropPat | TPropPat ',' | TPropPat ',' TPropPats | '...' TTarget
TPropPat = Id TInit? | PropName ':' TTarget TInit?
TArrPat = | ',' TArrPat | '...' TTarget | TTarget TInit? | TTarget TInit? ',' TArrPat
TInit = '=' TNoComma
TFuncTail = TParams? (TFnParams) TRet? TFuncEnd
TFuncEnd = {TBody} | Semi
TFuncAny = 'async'? 'function' '*'? Id? TFuncTail
TFuncDecl = 'async'? 'function' '*'? Id TFuncTail
TBody = TStmt*
TStmt = {TBody} | TVarDecl | TFuncDecl | TClassDecl | TDeclOnly | 'if' (TExpr) NL? TStmt TElse? | 'for' 'await'? (TForHead) NL? TStmt | 'while' (TExpr) NL? TStmt | 'do' NL? TStmt 'while' (TExpr) Semi? | 'switch' (TExpr) {TCases} | 'try' {TBody} THandler | 'return' TExpr? Semi | 'throw' TExpr Semi | 'break' Id? Semi | 'continue' Id? Semi | 'debugger' Semi | Id ':' NL? TStmt | ';' | NL | TExpr Semi
TElse = 'else' NL? TStmt
TForHead = TForInit? ';' TExpr? ';' TExpr? | VarKind TTarget 'of' TNoComma | VarKind TTarget 'in' TExpr | TOperand 'of' TNoComma | TOperand 'in' TExpr
TForInit = VarKind TBinding TBindings | TExpr
TCases = TCase*
TCase = 'case' TExpr ':' TStmt* | 'default' ':' TStmt* | NL
THandler = NL? TCatch | NL? TFinally | NL? TCatch NL? TFinally
TCatch = 'catch' {TBody} | 'catch' (TCatchParam) {TBody}
TCatchParam = TTarget TAnn?
TFinally = 'finally' {TBody}
TVarDecl = VarKind TBinding TBindings Semi
TBindings = | ',' TBinding TBindings
TBinding = TTarget '!'? TAnn? TInit?
TClassDecl = TDecorator* 'abstract'? 'class' Id TParams? THeritage? TImplements? {TClassBody} | TDecorator* 'export' 'default'? 'abstract'? 'class' Id TParams? THeritage? TImplements? {TClassBody}
TClassAny = TDecorator* 'class' Id? TParams? THeritage? TImplements? {TClassBody}
TDecorator = '@' Id TDecRest* NL? | '@' (TExpr) NL?
TDecRest = '.' Name | (TArgsList) | TArgs
THeritage = 'extends' TOperand TArgs?
TImplements = 'implements' TRefs
TClassBody = TClassMember*
TClassMember = ';' | NL | TDecorator* TClassMod* TClassRest | 'static' {TBody} | TClassMod* [TIndex] TAnn Semi
TClassMod = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'override' | 'readonly' | 'declare' | 'accessor'
TClassRest = 'async'? '*'? PropName '?'? TFuncTail | Accessor PropName TFuncTail | PropName TOptBang? TAnn? TInit? Semi
TOptBang = '?' | '!'
TExpr = TNoComma | TNoComma ',' TExpr
TNoComma = TArrow | 'yield' | 'yield' '*'? TNoComma | TUnary TMore
TMore = | BinOp TNoComma | '?' TNoComma ':' TNoComma | TAsOp TMore
TAsOp = 'as' Type | 'as' 'const' | 'satisfies' Type
TUnary = TOperand | Pre TUnary | TOperand '++' | TOperand '--' | TArgs TUnary
TOperand = TPrimary TPostfix*
TPostfix = '.' Name | '.' PRIVATE | '?.' Name | '?.' PRIVATE | '?.' TArgs? (TArgsList) | '?.' [TExpr] | TArgs (TArgsList) | TArgs `TTplParts` | (TArgsList) | [TExpr] | `TTplParts` | '!'
TPrimary = Id | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | `TTplParts` | (TExpr) | [TArrBody] | {TObjBody} | TFuncAny | TClassAny | 'new' TOperand TArgs? | 'new' '.' 'target' | 'import' (TArgsList) | 'import' '.' Name | PRIVATE
TTplParts = TTplPart*
TTplPart = (TExpr)
TArgsList = TArgItems?
TArgItems = TArg | TArg ',' | TArg ',' TArgItems
TArg = TNoComma | '...' TNoComma
TArrBody = | ',' TArrBody | TArg | TArg ',' TArrBody
TObjBody = TProps? NL?
TProps = TProp | TProp ',' | TProp ',' TProps
TProp = Id | Id TInit | PropName ':' TNoComma | '...' TNoComma | 'async'? '*'? PropName TFuncTail | Accessor PropName TFuncTail
TArrow = 'async'? Id '=>' TArrowBody | 'async'? TParams? (TFnParams) TRet? '=>' TArrowBody
TArrowBody = {TBody} | TNoComma
"""
ECMA_SOFT = {"as", "async", "from", "of", "get", "set", "static", "type", "accessor", "let", "yield", "await", "using", "is", "target"}
ECMA_HARD = set("this super null true false import export with default function return throw break continue debugger const var if else for in while do switch case try catch finally class extends instanceof typeof void delete new enum".split())
#: words that are keywords of the TypeScript rules only; to JavaScript they are identifiers
TS_WORDS = set("interface declare global namespace module abstract implements public private protected readonly override keyof unique infer asserts satisfies out".split())

JAVA = r"""
Unit = Package? Import* Decl*
Package = Annot* 'package' QName ';'
Import = 'import' 'static'? QName ';' | 'import' 'static'? QName '.' '*' ';' | ';'
QName = Id QRest*
QRest = '.' Id
Decl = Mod* TypeDecl | ';'
Mod = Annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed'
Annot = '@' QName | '@' QName (AnnArgs)
AnnArgs = | AnnVal | AnnPairs
AnnPairs = Id '=' AnnVal | Id '=' AnnVal ',' AnnPairs
AnnVal = Cond | Annot | {AnnList}
AnnList = | ',' | AnnVal | AnnVal ',' AnnList
TypeDecl = 'class' Id TParams? Extends? Implements? Permits? {ClassBody} | 'interface' Id TParams? IExtends? Permits? {ClassBody} | 'enum' Id Implements? {EnumBody} | '@' 'interface' Id {AnnBody} | 'record' Id TParams? (RecParams) Implements? {ClassBody}
TParams = '<' TParamList '>'
TParamList = TParam | TParam ',' TParamList
TParam = Annot* Id TBound?
TBound = 'extends' Type TBounds
TBounds = | '&' Type TBounds
Extends = 'extends' Type
IExtends = 'extends' Types
Implements = 'implements' Types
Permits = 'permits' Types
Types = Type | Type ',' Types
RecParams = RecList?
RecList = RecParam | RecParam ',' RecList
RecParam = Annot* Type '...'? Id
ClassBody = Member*
Member = ';' | {Block} | 'static' {Block} | Mod* MemberRest
MemberRest = TypeDecl | TParams? Type Id (Params) Dims Throws? MethodEnd | TParams? 'void' Id (Params) Throws? MethodEnd | TParams? Id (Params) Throws? {Block} | Id {Block} | Type Vars ';'
MethodEnd = {Block} | ';' | 'default' AnnVal ';'
Throws = 'throws' Types
Params = ParamList?
ParamList = Param | Param ',' ParamList
Param = PMod* Type '...'? Id Dims | PMod* Type QThis
QThis = 'this' | Id '.' QThis
PMod = 'final' | Annot
AnnBody = AnnMember*
AnnMember = Member | Mod* Type Id (Params) Dims 'default' AnnVal ';'
EnumBody = EnumConsts? EnumRest?
EnumConsts = EnumConst | EnumConst ',' | EnumConst ',' EnumConsts
EnumConst = Annot* Id EnumArgs? EnumClass?
EnumArgs = (Args)
EnumClass = {ClassBody}
EnumRest = ';' Member*
Dims = | Dim Dims
Dim = Annot* [None_]
None_ =
Type = Annot* TypeBase Dims
TypeBase = PRIM | ClassType
ClassType = Id TArgs? CRest*
CRest = '.' Annot* Id TArgs?
TArgs = '<' TArgList? '>'
TArgList = TArg | TArg ',' TArgList
TArg = Type | Annot* '?' | Annot* '?' 'extends' Type | Annot* '?' 'super' Type
Vars = Var | Var ',' Vars
Var = Id Dims VInit?
VInit = '=' VarInit
VarInit = Expr | {ArrInit}
ArrInit = | ',' | VarInit | VarInit ',' ArrInit
Block = BStmt*
BStmt = PMod* Type Vars ';' | LMod* TypeDecl | Stmt
LMod = 'final' | 'abstract' | 'static' | 'strictfp' | Annot
Stmt = {Block} | ';' | 'if' (Expr) Stmt Else? | 'while' (Expr) Stmt | 'do' Stmt 'while' (Expr) ';' | 'for' (ForHead) Stmt | 'switch' (Expr) {Switch} | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';' | 'assert' Expr ';' | 'assert' Expr ':' Expr ';' | 'synchronized' (Expr) {Block} | Try | Id ':' Stmt | StmtExpr ';'
Else = 'else' Stmt
ForHead = ForInit? ';' Expr? ';' Exprs? | PMod* Type Id ':' Expr
ForInit = PMod* Type Vars | Exprs
Exprs = Expr | Expr ',' Exprs
Switch = SwitchOne*
SwitchOne = Case ':' BStmt* | 'default' ':' BStmt* | Case '->' SwitchEnd | 'default' '->' SwitchEnd
Case = 'case' Labels | 'case21' Labels21
Labels = Label | Label ',' Labels
Label = Cond | 'default' | PMod* Type Id
Labels21 = Label21 | Label21 ',' Labels21
Label21 = Cond | 'default' | Pattern When?
Pattern = PMod* Type Id | Type (Patterns) Id?
Patterns = | PatternList
PatternList = Pattern | Pattern ',' PatternList
When = 'when' Expr
SwitchEnd = {Block} | Expr ';' | 'throw' Expr ';'
Try = 'try' {Block} Handlers | 'try' (Res) {Block} Catch* Finally?
Handlers = Catch Catch* Finally? | Finally
Catch = 'catch' (CatchParam) {Block}
CatchParam = PMod* CatchTypes Id
CatchTypes = ClassType | ClassType '|' CatchTypes
Finally = 'finally' {Block}
Res = ResOne | ResOne ';' | ResOne ';' Res
ResOne = PMod* Type Id '=' Expr | Expr
StmtExpr = Pre2 Unary | Operand '++' | Operand '--' | Operand AssignOp Expr | Operand
Pre2 = '++' | '--'
AssignOp = '=' | ASSIGN | '>' '>=' | '>' '>' '>='
Expr = Lambda | Unary More
Cond = Lambda | Unary More
More = | BinOp Expr | 'instanceof' PMod* Type Id? More | 'instanceof21' PMod* Type Id? More | 'instanceof21' Type (Patterns) Id? More | '?' Expr ':' Expr
BinOp = '=' | ASSIGN | OP | '+' | '-' | '*' | '/' | '<' | '>' | '>=' | '&' | '|' | '>' '>' | '>' '>' '>' | '>' '>=' | '>' '>' '>='
Lambda = Id '->' LambdaBody | (LambdaParams) '->' LambdaBody
LambdaParams = | Ids | ParamList
Ids = Id | Id ',' Ids
LambdaBody = {Block} | Expr
Unary = Operand | Pre Unary | Operand '++' | Operand '--' | (Cast) CastRest
Cast = Type | Type '&' CastMore
CastMore = Type | Type '&' CastMore
CastRest = Unary | Lambda
Pre = '+' | '-' | '!' | '~' | '++' | '--'
Operand = Primary Post*
Post = '.' TArgs? Id | '.' 'this' | '.' 'super' | '.' 'class' | '.' 'new' TArgs? Annot* Id TArgs? (Args) EnumClass? | (Args) | [Expr] | '::' TArgs? Id | '::' 'new'
Primary = Id | LIT | 'this' | 'super' | (Expr) | 'new' New | PRIM Dims '.' 'class' | 'void' '.' 'class' | PRIM Dims '::' 'new' | ClassType Dims '::' MRef | ClassType Dim Dims '.' 'class' | 'switch' (Expr) {Switch}
MRef = 'new' | Id
New = Annot* ClassType (Args) EnumClass? | Annot* NewBase NewDims | Annot* NewBase Dim Dims {ArrInit}
NewBase = PRIM | ClassType
NewDims = Annot* [Expr] NewDimsMore
NewDimsMore = | Annot* [Expr] NewDimsMore | Dim Dims
Args = ArgList?
ArgList = Expr | Expr ',' ArgList
Id = ID | 'record' | 'sealed' | 'permits' | 'yield' | 'when'
"""
JAVA_WORDS = set("package import static public private protected final abstract native synchronized transient volatile strictfp default sealed permits class interface enum record extends implements throws this super void new if else while do for switch case return throw break continue yield assert try catch finally instanceof".split())
JAVA_PRIM = {"int", "long", "short", "byte", "char", "boolean", "float", "double"}
JAVA_LIT = {"true", "false", "null"}
JAVA_DEAD = {"const", "goto", "_"}

PHP = r"""
File = Item*
Item = 'namespace' QName ';' | 'namespace' QName {Inner} | 'namespace' {Inner} | 'use' UseKind? Uses ';' | 'const' Consts ';' | '__halt_compiler' (None_) ';' | Stmt
Inner = Item*
None_ =
UseKind = 'function' | 'const'
Uses = Use | Use ',' Uses
Use = QName | QName 'as' Id | GroupName {GroupUse}
GroupName = QName '\'
GroupUse = | GUse | GUse ',' GroupUse
GUse = UseKind? QName | UseKind? QName 'as' Id
Consts = Id '=' Expr | Id '=' Expr ',' Consts
QName = '\'? Id QRest*
QRest = '\' AnyName
Block = Item*
Stmt = {Block} | 'if' (Expr) Stmt ElseIf* Else? | 'if' (Expr) ':' Stmt* AltElseIf* AltElse? 'endif' End | 'while' (Expr) Stmt | 'while' (Expr) ':' Stmt* 'endwhile' End | 'do' Stmt 'while' (Expr) End | 'for' (ForHead) Stmt | 'for' (ForHead) ':' Stmt* 'endfor' End | 'foreach' (Each) Stmt | 'foreach' (Each) ':' Stmt* 'endforeach' End | 'switch' (Expr) {Cases} | 'switch' (Expr) ':' Case* 'endswitch' End | 'break' Expr? End | 'continue' Expr? End | 'return' Expr? End | 'echo' Exprs End | 'print' Expr End | 'global' Exprs End | 'static' StaticVars End | 'unset' (Args) End | 'try' {Block} Catch* Finally? | 'throw' Expr End | 'declare' (Consts) End | 'declare' (Consts) {Block} | 'goto' Id End | ID ':' | FuncDecl | ClassDecl | End | Expr End | HTML
End = ';' | HTML
ElseIf = 'elseif' (Expr) Stmt | 'else' 'if' (Expr) Stmt
Else = 'else' Stmt
AltElseIf = 'elseif' (Expr) ':' Stmt*
AltElse = 'else' ':' Stmt*
ForHead = Exprs? ';' Exprs? ';' Exprs?
Exprs = Expr | Expr ',' | Expr ',' Exprs
Each = Expr 'as' EachVar | Expr 'as' EachVar '=>' EachVar
EachVar = '&'? Expr
Cases = ';'? Case*
Case = 'case' Expr CaseEnd Stmt* | 'default' CaseEnd Stmt*
CaseEnd = ':' | ';'
StaticVars = VAR Init? | VAR Init? ',' StaticVars
Init = '=' Expr
Catch = 'catch' (CatchParam) {Block}
CatchParam = Names VAR?
Names = QName | QName '|' Names
Finally = 'finally' {Block}
Attr = '#' [AttrList]
AttrList = | AttrOne | AttrOne ',' AttrList
AttrOne = QName | QName (Args)
FuncDecl = Attr* 'function' '&'? FuncName (Params) Ret? {Block}
FuncName = Id | 'readonly'
Ret = ':' Type
Type = '?' TypeOne | TypeMore
TypeMore = TypeOne | TypeOne '|' TypeMore | TypeOne '&' TypeMore
TypeOne = QName | 'array' | 'callable' | 'static' | 'null' | (TypeMore)
Params = | Param | Param ',' Params
Param = Attr* PMod* Type? '&'? '...'? VAR Init? HookPart?
HookPart = {Hooks}
PMod = 'public' | 'private' | 'protected' | 'readonly' | 'public' (SetOnly) | 'private' (SetOnly) | 'protected' (SetOnly) | 'final'
SetOnly = ID
ClassDecl = Attr* CMod* 'class' Id Extends? Implements? {ClassBody} | Attr* 'interface' Id IExtends? {ClassBody} | Attr* 'trait' Id {ClassBody} | Attr* 'enum' Id Ret? Implements? {EnumBody}
CMod = 'abstract' | 'final' | 'readonly'
Extends = 'extends' QName
IExtends = 'extends' Comma
Implements = 'implements' Comma
Comma = QName | QName ',' Comma
ClassBody = Member*
EnumBody = EnumMember*
EnumMember = Member | Attr* 'case' AnyName Init? ';'
Member = 'use' Comma UseEnd | Attr* MMod* MemberRest
UseEnd = ';' | {Adapts}
Adapts = Adapt*
Adapt = AdName 'insteadof' Comma ';' | AdName 'as' MMod? AnyName? ';'
AdName = AnyName | QName '::' AnyName
MMod = 'public' | 'private' | 'protected' | 'public' (SetOnly) | 'private' (SetOnly) | 'protected' (SetOnly) | 'static' | 'abstract' | 'final' | 'readonly' | 'var'
MemberRest = 'function' '&'? AnyName (Params) Ret? FuncEnd | 'const' MConsts ';' | 'const' Type MConsts ';' | Type? Props ';' | Type? VAR Init? {Hooks}
Hooks = Hook*
Hook = Attr* 'final'? '&'? ID HookArgs? HookEnd
HookArgs = (Params)
HookEnd = ';' | {Block} | '=>' Expr ';'
MConsts = AnyName '=' Expr | AnyName '=' Expr ',' MConsts
FuncEnd = {Block} | ';'
Props = VAR Init? | VAR Init? ',' Props
Expr = Unary More
More = | BinOp Expr | '=' '&' Expr | '?' Expr? ':' Expr | 'instanceof' Expr | '?:' Expr
BinOp = '=' | ASSIGN | OP | '+' | '-' | '*' | '/' | '<' | '>' | '.' | '&' | '|' | 'and' | 'or' | 'xor'
Unary = Operand | Pre Unary | Operand '++' | Operand '--'
Pre = '+' | '-' | '!' | '~' | '@' | '&' | '++' | '--' | CAST | 'new' | 'clone' | 'print' | 'include' | 'include_once' | 'require' | 'require_once' | 'throw' | 'yield' 'from'
Operand = Primary Post*
Post = '->' Prop | '?->' Prop | '::' Stat | (Args) | [Expr?] | 'curly' {Expr}
Prop = AnyName | VAR | {Expr} | '$' {Expr}
Stat = AnyName | VAR | 'class' | '$' {Expr} | '$' VAR
Primary = VAR | '$' VAR | '$' {Expr} | NUM | STR | `Parts` | QName | 'null' | 'static' | 'array' (ArrItems) | 'list' (ArrItems) | 'isset' (Args) | 'empty' (Expr) | 'exit' ExitArgs? | 'eval' (Expr) | 'unset' (Args) | (Expr) | [ArrItems] | Attr* 'static'? 'function' '&'? (Params) UseVars? Ret? {Block} | Attr* 'static'? 'fn' '&'? (Params) Ret? '=>' Expr | 'match' (Expr) {Arms} | 'yield' | 'yield' Expr | 'yield' Expr '=>' Expr | NewClass
NewClass = 'readonly'? 'class' Ctor? Extends? Implements? {ClassBody}
Ctor = (Args)
ExitArgs = (Args)
Parts = Part*
Part = (Expr)
UseVars = 'use' (UseVarList)
UseVarList = | UseVar | UseVar ',' UseVarList
UseVar = '&'? VAR
Args = | Arg | Arg ',' Args
Arg = Expr | '...' Expr | AnyName ':' Expr | '...'
ArrItems = | ',' ArrItems | ArrItem | ArrItem ',' ArrItems
ArrItem = Expr | Expr '=>' Expr | '...' Expr
Arms = | Arm | Arm ',' Arms
Arm = ArmConds '=>' Expr | 'default' ','? '=>' Expr
ArmConds = Expr | Expr ',' | Expr ',' ArmConds
Id = ID | 'enum' | 'match' | 'readonly'
AnyName = ID | WORD | 'enum' | 'match' | 'readonly' | 'namespace' | 'use' | 'const' | 'function' | 'as' | 'if' | 'else' | 'elseif' | 'while' | 'do' | 'for' | 'foreach' | 'switch' | 'case' | 'default' | 'break' | 'continue' | 'return' | 'echo' | 'print' | 'global' | 'static' | 'unset' | 'try' | 'catch' | 'finally' | 'throw' | 'declare' | 'goto' | 'array' | 'callable' | 'null' | 'class' | 'interface' | 'trait' | 'extends' | 'implements' | 'abstract' | 'final' | 'public' | 'private' | 'protected' | 'var' | 'insteadof' | 'instanceof' | 'and' | 'or' | 'xor' | 'new' | 'clone' | 'include' | 'include_once' | 'require' | 'require_once' | 'yield' | 'from' | 'list' | 'isset' | 'empty' | 'exit' | 'eval' | 'fn'
"""
PHP_WORDS = set("namespace use const function as if else elseif endif while endwhile do for endfor foreach endforeach switch endswitch case default break continue return echo print global static unset try catch finally throw declare goto array callable null class interface trait enum extends implements abstract final public private protected readonly var insteadof instanceof and or xor new clone include include_once require require_once yield list isset empty exit eval fn match __halt_compiler".split())

PYTHON = r"""
File = Stmt*
Stmt = Simple | Compound | NL
Simple = Small NL | Small ';' NL | Small ';' Simple
Small = Star | Targets '=' AssignEnd | Single ASSIGN Value | Ann ':' Expr AnnInit? | 'del' Targets | 'pass' | 'break' | 'continue' | 'return' Star? | 'raise' Raise? | 'global' Names | 'nonlocal' Names | 'import' Imports | 'from' From 'import' FromRest | 'assert' Expr Msg? | Yield | 'type' Id TParams? '=' Expr | 'print2' Print2 | 'exec2' Expr Exec2?
AssignEnd = Value | Targets '=' AssignEnd
AnnInit = '=' Value
Value = Star | Yield
Single = Id | Primary TPost | (Single)
Ann = Id | Primary TPost | (Single)
TPost = Post TPost | '.' Id | [Subs]
Target = Id | Primary TPost | (TTuple) | [TTuple] | '*' Target
TTuple = | Targets
Targets = Target | Target ',' | Target ',' Targets
Print2 = | Star | '>>' Expr | '>>' Expr ',' Star
Exec2 = 'in' Star
Raise = Expr | Expr 'from' Expr | Expr ',2' Expr | Expr ',2' Expr ',2' Expr
Names = Id | Id ',' Names
Imports = Import | Import ',' Imports
Import = Dotted As?
As = 'as' Id
Dotted = Id DRest*
DRest = '.' Id
From = Dots Dotted | Dots | Dotted
Dots = Dot Dot*
Dot = '.' | '...'
FromRest = '*' | FromNames | (FromParen)
FromNames = FromOne | FromOne ',' FromNames
FromParen = FromOne | FromOne ',' | FromOne ',' FromParen
FromOne = Id As?
Msg = ',' Expr
Yield = 'yield' Star? | 'yield' 'from' Expr
Compound = 'if' Named ':' Suite Elif* Else? | 'while' Named ':' Suite Else? | 'async'? 'for' Targets 'in' Star ':' Suite Else? | 'try' ':' Suite Handlers | 'async'? 'with' WithHead ':' Suite | Decorator* 'async'? 'def' Id TParams? (Params) Ret? ':' Suite | Decorator* 'class' Id TParams? Bases? ':' Suite | 'match' Star ':' NL {Cases}
Suite = Simple | NL {Block}
Block = Stmt*
Elif = 'elif' Named ':' Suite
Else = 'else' ':' Suite
Handlers = Except Except* Else? Finally? | ExceptStar ExceptStar* Else? Finally? | Finally
Except = 'except' ':' Suite | 'except' ExceptWhat ':' Suite
ExceptStar = 'except' '*' ExceptWhat ':' Suite
ExceptWhat = Expr As? | Expr ',2' Target
Finally = 'finally' ':' Suite
WithHead = WithItems | (WithParen)
WithItems = WithItem | WithItem ',' WithItems
WithParen = WithItem | WithItem ',' | WithItem ',' WithParen
WithItem = Expr | Expr 'as' Target
Decorator = '@' Named NL
TParams = [TParamList]
TParamList = TParam | TParam ',' | TParam ',' TParamList
TParam = TStar? Id TBound? TDefault?
TStar = '*' | '**'
TBound = ':' Expr
TDefault = '=' Starred
Params = | PNo PnTail | PDef PdTail | StarEtc
PNo = Id PAnn?
PDef = Id PAnn? '=' Expr
PAnn = ':' Expr
PnTail = | ',' | ',' PNo PnTail | ',' PDef PdTail | ',' '/' SnTail | ',' StarEtc
PdTail = | ',' | ',' PDef PdTail | ',' '/' SdTail | ',' StarEtc
SnTail = | ',' | ',' PNo SnTail | ',' PDef SdTail | ',' StarEtc
SdTail = | ',' | ',' PDef SdTail | ',' StarEtc
StarEtc = '*' Id StarAnn? KwTail | '*' ',' KwOnly KwTail | Kwds
StarAnn = ':' Starred
KwTail = | ',' | ',' KwOnly KwTail | ',' Kwds
KwOnly = PNo | PDef
Kwds = '**' Id PAnn? | '**' Id PAnn? ','
Ret = '->' Expr
Bases = (Args)
Cases = Case*
Case = 'case' Patterns Guard? ':' Suite | NL
Guard = 'if' Named
Patterns = Pattern | Pattern ',' | Pattern ',' Patterns
Pattern = PatOr PatAs?
PatAs = 'as' Id
PatOr = PatOne | PatOne '|' PatOr
PatOne = PatNum | Strings | 'None' | 'True' | 'False' | Dotted | Dotted (PatArgs) | (PatSeq) | [PatSeq] | {PatMap} | '*' Id
PatNum = '-'? NUM | '-'? NUM PatSign NUM
PatSign = '+' | '-'
PatArgs = | PatArg | PatArg ',' PatArgs
PatArg = Pattern | Id '=' Pattern
PatSeq = | Pattern | Pattern ',' PatSeq
PatMap = | PatKV | PatKV ',' PatMap
PatKV = PatOne ':' Pattern | '**' Id
Star = Starred | Starred ',' | Starred ',' Star
Starred = Named | '*' Unary BitMore
BitMore = | BinOp Unary BitMore
Named = Expr | Id ':=' Expr
Expr = Or | Or 'if' Or 'else' Expr | 'lambda' LParams ':' Expr
LParams = | Id LnTail | LDef LdTail | LStarEtc
LDef = Id '=' Expr
LnTail = | ',' | ',' Id LnTail | ',' LDef LdTail | ',' '/' LsnTail | ',' LStarEtc
LdTail = | ',' | ',' LDef LdTail | ',' '/' LsdTail | ',' LStarEtc
LsnTail = | ',' | ',' Id LsnTail | ',' LDef LsdTail | ',' LStarEtc
LsdTail = | ',' | ',' LDef LsdTail | ',' LStarEtc
LStarEtc = '*' Id LKwTail | '*' ',' LKwOnly LKwTail | LKwds
LKwTail = | ',' | ',' LKwOnly LKwTail | ',' LKwds
LKwOnly = Id | LDef
LKwds = '**' Id | '**' Id ','
Or = Not | Not BoolOp Or
BoolOp = 'and' | 'or'
Not = 'not' Not | Unary CmpMore
CmpMore = | Cmp Unary CmpMore | Cmp 'lambda2' LParams ':' Expr
Cmp = BinOp | CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not'
BinOp = OP | '+' | '-' | '*' | '**' | '/' | '|' | '@' | '>>'
Unary = Pre Unary | Operand | 'await' Unary
Pre = '+' | '-' | '~'
Operand = Primary Post*
Post = '.' Id | (Args) | [Subs]
Primary = Id | NUM | Strings | '...' | 'None' | 'True' | 'False' | (Paren) | [List] | {Braces} | BACKTICK
Strings = Text Text* | BYTES BYTES*
Text = STR | `Fields`
Fields = Field*
Field = (FieldExpr)
FieldExpr = Star '='? | Yield '='?
Paren = | Star | Yield | Named Comp
List = | Star | Named Comp
Braces = | Star | Named Comp | Dict | Expr ':' Expr Comp
Dict = Pair | Pair ',' | Pair ',' Dict
Pair = Expr ':' Expr | '**' Unary BitMore
Comp = CompFor CompRest*
CompFor = 'async'? 'for' Targets 'in' Or
CompRest = CompFor | 'if' Or
Args = | Named Comp | ArgList
ArgList = Pos | Pos ',' | Pos ',' ArgList | KwArgs
Pos = Named | '*' Expr
KwArgs = KwS | KwS ',' | KwS ',' KwArgs | KwDs
KwS = Id '=' Expr | '*' Expr
KwDs = KwD | KwD ',' | KwD ',' KwDs
KwD = Id '=' Expr | '**' Expr
Subs = Sub | Sub ',' | Sub ',' Subs
Sub = Starred | Expr? ':' Expr? SubStep?
SubStep = ':' Expr?
Id = ID | 'match' | 'case' | 'type'
"""
PYTHON_WORDS = set("del pass break continue return raise global nonlocal import from assert yield as if elif else while for in try except finally with async await def class match case type and or not is lambda None True False".split())


# --- scanners --------------------------------------------------------------------------------------------------------
class Stack:
    """Open groups of a scan; closes and folds them."""

    def __init__(self, folder: Folder) -> None:
        self.folder = folder
        self.open: list[tuple[str, list[str]]] = []
        self.now: list[str] = []

    def push(self, kind: str) -> None:
        self.open.append((kind, self.now))
        self.now = []

    def pop(self, closer: str) -> None:
        if not self.open or CLOSER[self.open[-1][0]] != closer:
            raise Reject(f"unmatched {closer}")
        kind, outer = self.open.pop()
        outer.append(self.folder.fold(kind, "".join(self.now)))
        self.now = outer

    def end(self) -> str:
        if self.open:
            raise Reject(f"{self.open[-1][0]} is never closed")
        return "".join(self.now)


_ECMA = re.compile(
    r"[ \t\r\v\f\ufeff\xa0]*(?:(?P<nl>\n[\s\ufeff]*|[\u2028\u2029])|(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)"
    r"|(?P<id>[A-Za-z_$][\w$]*|[^\W\d][\w$]*|\\u[0-9a-fA-F]{4}[\w$]*)|(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"
    r"|(?P<str>'(?:[^'\\\n]|\\(?:\r\n|.|\n))*'|\"(?:[^\"\\\n]|\\(?:\r\n|.|\n))*\")|(?P<tpl>`)"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|>>|[-+*/%<>=!~&|^?:;,.@])"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<priv>\#[A-Za-z_$][\w$]*))",
    re.S,
)
_HTML_COMMENT = re.compile(r"<!--[^\n]*|(?<![^\n])[ \t]*-->[^\n]*")
_TAG_NAME = re.compile(r"\s*([A-Za-z_$][\w$-]*(?:[.:][A-Za-z_$][\w$-]*)*)?")
_TAG_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_TAG_KEY = re.compile(r"[A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*)?")
_TAG_TEXT = re.compile(r"[^<{}>]*")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_ECMA_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="}
_ECMA_OP = {"===", "!==", "==", "!=", "<=", ">=", "&&", "||", "??", "<<", ">>>", "**", "%", "^"}
_ECMA_GO_ON = set("+-*/%&|^<>=?:.,)]}(`[") | _ECMA_ASSIGN | _ECMA_OP | {"=>", "?.", ">>", "{", "in", "instanceof", "else", "extends", "implements", "catch", "finally", "as", "satisfies"}


class Ecma:
    """Scans JavaScript or TypeScript into folded tokens."""

    def __init__(self, grammar: Grammar) -> None:
        self.g = grammar
        c = grammar.char
        self.words = {w: c(w) for w in ECMA_SOFT | ECMA_HARD}
        self.ts_words = self.words | {w: c(w) for w in TS_WORDS}
        self.id, self.soft, self.num, self.str, self.re, self.nl, self.priv, self.assign, self.op = (c(x) for x in ("ID", "SOFT", "NUM", "STR", "REGEX", "NL", "PRIVATE", "ASSIGN", "OP"))
        self.no_value = {c(w) for w in ECMA_HARD if w not in ("this", "super", "null", "true", "false")}
        self.sloppy_words = self.words | {"with": c("with2")}
        signs = ("...", "=>", "?.", "++", "--", "+", "-", "*", "/", "<", ">", "=", "!", "~", "&", "|", "?", ":", ";", ",", ".", "@", ">>")
        self.ops = {t: self.assign for t in _ECMA_ASSIGN} | {t: self.op for t in _ECMA_OP} | {t: c(t) for t in signs}
        self.ts_ops = self.ops
        self.semi, self.comma = c(";"), c(",")
        self.stop = {c(w) for w in ("return", "break", "continue", "debugger", "yield", "await", "of", "++", "--", "!")}
        self.jsx = self.sloppy = False

    def _jsx(self, text: str, at: int, ts: bool) -> tuple[str, int] | None:
        """The element or fragment that begins at the ``<``, as a template whose parts are its expressions; None if it's none."""
        parts: list[str] = []
        end = self._element(text, at, ts, parts)
        return None if end is None else (self.g.folder.fold("`", "".join(parts)), end)

    def _element(self, text: str, at: int, ts: bool, parts: list[str]) -> int | None:
        m = _TAG_NAME.match(text, at + 1)
        name, at = m.group(1) or "", _TAG_SPACE.match(text, m.end()).end()
        if not name and not text.startswith(">", at):
            return None
        if ts and (text.startswith(",", at) or text.startswith("extends ", at)):  # a generic arrow
            return None
        while not text.startswith((">", "/>"), at):
            if text.startswith("{", at):
                at = self._braces(text, at, ts, parts, True)
            else:
                m = _TAG_KEY.match(text, at)
                if m is None:
                    raise Reject(f"a bad attribute at {at}")
                at = _TAG_SPACE.match(text, m.end()).end()
                if text.startswith("=", at):
                    at = _TAG_SPACE.match(text, at + 1).end()
                    if text.startswith("{", at):
                        at = self._braces(text, at, ts, parts, True)
                    elif text.startswith("<", at):
                        at = self._element(text, at, ts, parts)
                    elif text[at : at + 1] in ("'", '"') and (k := text.find(text[at], at + 1)) > 0:
                        at = k + 1
                    else:
                        raise Reject(f"a bad attribute value at {at}")
            if at is None:
                raise Reject("a bad element")
            at = _TAG_SPACE.match(text, at).end()
        if text.startswith("/>", at):
            return at + 2
        at += 1
        while True:
            at = _TAG_TEXT.match(text, at).end()
            if text.startswith("{", at):
                at = self._braces(text, at, ts, parts, False)
            elif text.startswith("<", at):
                k = _TAG_SPACE.match(text, at + 1).end()
                if text.startswith("/", k):
                    m = _TAG_NAME.match(text, k + 1)
                    k = _TAG_SPACE.match(text, m.end()).end()
                    if (m.group(1) or "") != name or not text.startswith(">", k):
                        raise Reject(f"an element is closed by another one's tag at {at}")
                    return k + 1
                at = self._element(text, at, ts, parts)
                if at is None:
                    raise Reject("a bad element")
            else:
                raise Reject(f"an element is never closed at {at}")

    def _braces(self, text: str, at: int, ts: bool, parts: list[str], needed: bool) -> int:
        inner, end = self._scan(text, at + 1, ts, "}")
        inner = inner.removesuffix(self.nl)
        dots = self.g.char("...")
        if inner.startswith(dots):
            inner, needed = inner[1:], True
        if inner or needed:
            parts.append(self.g.folder.fold("(", inner))
        return end

    def scan(self, text: str, ts: bool, jsx: bool = False, sloppy: bool = False) -> str:
        if text.startswith("#!"):
            text = text[text.find("\n") if "\n" in text else len(text) :]
        self.jsx, self.sloppy = jsx, sloppy
        if sloppy and ("<!--" in text or "-->" in text):
            text = _HTML_COMMENT.sub("", text)
        out, end = self._scan(text, 0, ts, None)
        return out

    def _scan(self, text: str, at: int, ts: bool, until: str | None) -> tuple[str, int]:
        words = self.ts_words if ts else self.sloppy_words if self.sloppy else self.words
        st = Stack(self.g.folder)
        match, n = _ECMA.match, len(text)
        jsx, sloppy = self.jsx, self.sloppy
        prev, line = "", False  # prev: the last token's text or class; line: a line end came since
        value = False  # whether an operand ends here
        nl, semi, ops = self.nl, self.semi, self.ts_ops if ts else self.ops
        while at < n:
            m = match(text, at)
            if m is None:
                if not text[at:].strip(" \t\r\v\f\ufeff\xa0"):
                    break
                raise Reject(f"unexpected {text[at]!r} at {at}")
            what = m.lastgroup
            if what == "nl":
                line = True
                at = m.end()
                continue
            t = m.group(what)
            if what == "c":
                line = line or "\n" in t
                at = m.end()
                continue
            at = m.start(what)
            block = not st.open or st.open[-1][0] == "{"
            if what == "op" and text.startswith("/*", at):
                raise Reject("a comment is never closed")
            if what == "op" and t[0] == "/" and not value:
                m = _REGEX.match(text, at)
                if m is None:
                    raise Reject(f"unexpected / at {at}")
                what, t = "re", m.group()
            if jsx and t == "<" and not value and (tag := self._jsx(text, at, ts)) is not None:
                part, end = tag
                if line and block and st.now and (st.now[-1] in self.stop or st.now[-1] not in (nl, semi) and value):
                    st.now.append(nl)
                line = False
                st.now.append(part)
                at, value, prev = end, True, "jsx"
                continue
            if line and block and st.now:
                last = st.now[-1]
                ends = value or last in self.stop
                goes_on = t in _ECMA_GO_ON and not (t == "else" and (ord(last) < BASE or self.g.folder.groups[ord(last) - BASE][0] != "{"))
                if not goes_on and ends and last not in (nl, semi) or (t in ("++", "--") and value):
                    st.now.append(nl)
            line = False
            at = m.end()
            if what == "id":
                c = words.get(t)
                if prev == "." or prev == "?.":
                    value = True
                    st.now.append(c or self.id)
                else:
                    st.now.append(c or self.id)
                    value = c is None or c not in self.no_value
                    if c is not None and t in ("await", "yield", "of", "typeof", "keyof"):
                        value = False
            elif what == "op":
                if ts and t in (">>", ">>>"):
                    st.now += [ops[">"]] * len(t)
                else:
                    st.now.append(ops[t])
                value = t in ("++", "--") and value or (t == "!" and ts and value)
            elif what == "num":
                if at < n and (text[at].isalnum() or text[at] in "_$"):
                    raise Reject(f"bad number at {at}")
                if len(t) > 1 and t[0] == "0" and t[1].isdigit() and not (sloppy and t.isdigit()) or t.endswith("_"):
                    raise Reject(f"bad number at {at}")
                st.now.append(self.num)
                value = True
            elif what == "str":
                st.now.append(self.str)
                value = True
            elif what == "re":
                st.now.append(self.re)
                value = True
            elif what == "open":
                st.push(t)
                value = False
            elif what == "close":
                if until == t and not st.open:
                    return st.end(), at
                if t == "}" and st.now and st.now[-1] not in (nl, semi, self.comma):
                    st.now.append(nl)
                st.pop(t)
                value = True
            elif what == "priv":
                st.now.append(self.priv)
                value = True
            else:  # a template
                parts: list[str] = []
                while True:
                    k = at
                    while k < n and text[k] != "`" and not text.startswith("${", k):
                        k += 2 if text[k] == "\\" else 1
                    if k >= n:
                        raise Reject("a template is never closed")
                    if text[k] == "`":
                        at = k + 1
                        break
                    inner, at = self._scan(text, k + 2, ts, "}")
                    parts.append(self.g.folder.fold("(", inner))
                st.now.append(self.g.folder.fold("`", "".join(parts)))
                value = True
            prev = t
        if until is not None:
            raise Reject("a template's expression is never closed")
        if st.now and st.now[-1] not in (nl, semi) and not st.open:
            st.now.append(nl)
        return st.end(), at


_JAVA = re.compile(
    r"(?P<ws>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<id>[A-Za-z_$][\w$]*|[^\W\d][\w$]*)"
    r"|(?P<num>0[xX](?:[\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?\d+[fFdD]?|[\da-fA-F_]+[lL]?)|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"
    r'|(?P<text>"""[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[btnfrs0-7"\'\\])*"(?!""))|(?P<chr>\'(?:[^\'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[btnfrs"\'\\])\')'
    r"|(?P<op>\.\.\.|<<=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%<>=!~&|^?:;,.@])|(?P<open>[(\[{])|(?P<close>[)\]}])",
    re.S,
)
_JAVA_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="}
_JAVA_OP = {"==", "!=", "<=", "&&", "||", "<<", "%", "^"}


class Java:
    def __init__(self, grammar: Grammar) -> None:
        c = grammar.char
        self.g = grammar
        self.words = {w: c(w) for w in JAVA_WORDS} | {w: c("PRIM") for w in JAVA_PRIM} | {w: c("LIT") for w in JAVA_LIT}
        self.ops = {t: c("ASSIGN") for t in _JAVA_ASSIGN} | {t: c("OP") for t in _JAVA_OP}
        self.id, self.lit = c("ID"), c("LIT")
        self.later = self.words | {"case": c("case21"), "instanceof": c("instanceof21"), "when": c("when")}

    def scan(self, text: str, later: bool = False) -> str:
        """With ``later``, Java 21."""
        st, at, n, match, prev = Stack(self.g.folder), 0, len(text), _JAVA.match, ""
        words, ops, char = self.later if later else self.words, self.ops, self.g.char
        text = text.rstrip("\x1a")
        n = len(text)
        while at < n:
            m = match(text, at)
            if m is None:
                raise Reject(f"unexpected {text[at]!r} at {at}")
            what, t = m.lastgroup, m.group()
            at = m.end()
            if what == "ws":
                continue
            if what == "id":
                if t in JAVA_DEAD:
                    raise Reject(f"{t} is no name")
                if t == "non" and text.startswith("-sealed", at):
                    at += 7
                    st.now.append(char("non-sealed"))
                else:
                    st.now.append(words.get(t) or self.id)
            elif what == "op":
                if t == "/" and text.startswith("*", at):
                    raise Reject("a comment is never closed")
                st.now.append(ops.get(t) or char(t))
            elif what == "open":
                st.push(t)
            elif what == "close":
                st.pop(t)
            else:
                if what == "num" and (at < n and (text[at].isalnum() or text[at] == "_") or t.endswith("_")):
                    raise Reject(f"bad number at {at}")
                st.now.append(self.lit)
            prev = t
        return st.end()


_PHP = re.compile(
    r"(?P<ws>\s+|//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<var>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<id>[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)"
    r"|(?P<num>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?\d*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*')|(?P<dq>\"(?:[^\"\\]|\\.)*\")|(?P<bt>`(?:[^`\\]|\\.)*`)"
    r"|(?P<here><<<[ \t]*(?P<q>['\"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)\r?\n)|(?P<close_tag>\?>\n?)|(?P<cast>\((?i:\s*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)\s*)\))"
    r"|(?P<op><=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|->|=>|::|\+\+|--|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\?:|[-+*/%<>=!~&|^?:;,.@$\\#])|(?P<open>[(\[{])|(?P<close>[)\]}])",
    re.S,
)
_PHP_ASSIGN = {"+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??="}
_PHP_OP = {"<=>", "===", "!==", "==", "!=", "<>", "<=", ">=", "&&", "||", "??", "<<", ">>", "**", "%", "^"}


class Php:
    def __init__(self, grammar: Grammar) -> None:
        c = grammar.char
        self.g = grammar
        self.words = {w: c(w) for w in PHP_WORDS} | {"die": c("exit")} | {w: c("WORD") for w in ("parent_",)}
        self.ops = {t: c("ASSIGN") for t in _PHP_ASSIGN} | {t: c("OP") for t in _PHP_OP}
        self.id, self.num, self.str, self.var, self.cast, self.html = (c(x) for x in ("ID", "NUM", "STR", "VAR", "CAST", "HTML"))

    def scan(self, text: str, old: bool = False) -> str:
        """With ``old``, PHP 7: offsets in braces and the casts that are gone."""
        st, n, match = Stack(self.g.folder), len(text), _PHP.match
        words, ops, char = self.words, self.ops, self.g.char
        at = self._html(text, 0, st)
        prev = ""
        while at < n:
            m = match(text, at)
            if m is None:
                raise Reject(f"unexpected {text[at]!r} at {at}")
            what, t = m.lastgroup, m.group()
            if what == "tag" or what == "q":
                what = "here"
            at = m.end()
            if what == "ws":
                continue
            if what == "id":
                if prev in ("->", "?->", "::") and t.lower() != "class":
                    st.now.append(self.id)
                elif prev == "yield" and t == "from":
                    st.now.append(char("from"))
                else:
                    st.now.append(words.get(t) or words.get(t.lower()) or self.id)
            elif what == "var":
                st.now.append(self.var)
            elif what == "op":
                if t == "/" and text.startswith("*", at):
                    raise Reject("a comment is never closed")
                st.now.append(ops.get(t) or char(t))
            elif what == "open":
                if old and t == "{" and (prev == "]" or prev[:1] == "$" and len(prev) > 1):
                    st.now.append(char("curly"))
                st.push(t)
            elif what == "close":
                st.pop(t)
            elif what == "close_tag":
                at = self._html(text, at, st)
            elif what == "cast":
                if not old and t[1:-1].strip().lower() in ("real", "unset"):
                    raise Reject(f"a cast that PHP 8 has not at {at}")
                st.now.append(self.cast)
            elif what == "here":
                tag = m.group("tag")
                e = re.compile(rf"^[ \t]*{tag}\b", re.M).search(text, at)
                if e is None:
                    raise Reject("a heredoc is never closed")
                at = e.end()
                st.now.append(self.str)
            else:
                if what == "num" and at < n and (text[at].isalnum() or text[at] == "_"):
                    raise Reject(f"bad number at {at}")
                if what == "num" and len(t) > 1 and t[0] == "0" and t.isdigit() and set(t) & {"8", "9"}:
                    raise Reject(f"bad number at {at}")
                st.now.append(self.num if what == "num" else self.str)
            prev = t
        return st.end()

    def _html(self, text: str, at: int, st: Stack) -> int:
        """Text outside of the tags is one HTML token; <?= opens an echo."""
        k = text.find("<?", at)
        while k >= 0 and not re.match(r"<\?(?:php(?=\s|$)|=)", text[k : k + 6], re.I):
            k = text.find("<?", k + 2)
        st.now.append(self.html)
        if k < 0:
            return len(text)
        if text.startswith("<?=", k):
            st.now.append(self.g.char("echo"))
            return k + 3
        return k + 5


_PY = re.compile(
    r"[ \t\f]*(?:\\\n[ \t\f]*)*(?:((?i:[rbu]|br|rb)?(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"))|((?i:f|fr|rf)(?:'''|\"\"\"|'|\"))"
    r"|([^\W\d]\w*)|(\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\.(?!\d)|[-+*/%<>=~&|^:;,@])|([(\[{])|([)\]}])|((?:\#[^\n]*)?\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*([ \t\f]*))"
    r"|(0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))",
    re.S,
)
_PY_ASSIGN = {"+=", "-=", "*=", "/=", "//=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "@="}
_PY_OP = {"//", "%", "<<", "&", "^"}
_PY_CMP = {"<", ">", "==", "!=", "<=", ">="}
_PY2 = re.compile(r"[ \t\f]*(?:\\\n[ \t\f]*)*(?:(<>)|(`[^`\n]*`)|(\d+[lL]|0[xX][\da-fA-F]+[lL]|0[0-7]+[lL]?)(?!\w)|((?i:ur)(?='|\")))")
_ESCAPE = re.compile(r"\\(?:x([\da-fA-F]{2})?|u([\da-fA-F]{4})?|U([\da-fA-F]{8})?|N(?:\{([^{}]+)\})?|.)", re.S)
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")


class Python:
    """Scans Python 3; with ``old``, Python 2. Indented blocks are ``{}`` groups, fields of f-strings ``()`` groups."""

    def __init__(self, grammar: Grammar) -> None:
        c = grammar.char
        self.g = grammar
        self.words = {w: c(w) for w in PYTHON_WORDS}
        old = {w: x for w, x in self.words.items() if w not in ("async", "await", "nonlocal", "match", "case", "type", "True", "False", "None")}
        self.old_words = old | {"print": c("print2"), "exec": c("exec2")}
        self.ops = {t: c("ASSIGN") for t in _PY_ASSIGN} | {t: c("OP") for t in _PY_OP} | {t: c("CMP") for t in _PY_CMP} | {t: c(t) for t in ("...", "->", ":=", "**", ">>", "+", "-", "*", "/", "=", "~", "|", ":", ";", ",", ".", "@")}
        self.id, self.num, self.str, self.bytes, self.nl, self.back, self.comma, self.old_comma, self.cmp = (c(x) for x in ("ID", "NUM", "STR", "BYTES", "NL", "BACKTICK", ",", ",2", "CMP"))

    def _string(self, t: str, at: int) -> str:
        """The class of a plain string, whose escapes are checked."""
        head = t[:2].lower()
        raw, data = "r" in head.split("'")[0].split('"')[0], "b" in head.split("'")[0].split('"')[0]
        if data and not t.isascii():
            raise Reject(f"bytes with other than ASCII at {at}")
        if "\\" in t and not raw:
            self._escapes(t, data, at)
        return self.bytes if data else self.str

    @staticmethod
    def _escapes(t: str, data: bool, at: int) -> None:
        for m in _ESCAPE.finditer(t):
            e = m.group()[1]
            if e == "x" and m.group(1) is None or not data and (e == "u" and m.group(2) is None or e == "U" and (m.group(3) is None or int(m.group(3), 16) > 0x10FFFF)):
                raise Reject(f"bad escape at {at}")
            if e == "N" and not data:
                try:
                    unicodedata.lookup(m.group(4) or "")
                except KeyError:
                    raise Reject(f"bad escape at {at}") from None

    def scan(self, text: str, old: bool = False) -> str:
        text = text.removeprefix("\ufeff")
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in text:
            raise Reject("a null byte")
        st = Stack(self.g.folder)
        indents = [(0, 0)]
        m = _PY_FIRST.match(text)
        if m.end() >= len(text):
            return ""
        self._indent(m.group(1), m.end(), indents, st)
        self._tokens(text + "\n", m.end(), st, indents, old)
        while len(indents) > 1:
            indents.pop()
            st.pop("}")
        return st.end()

    @staticmethod
    def _indent(blank: str, at: int, indents: list[tuple[int, int]], st: Stack) -> None:
        if "\t" in blank or "\f" in blank:
            width = alone = 0  # a tab goes to a multiple of 8, and counts 1 by itself: both must agree
            for ch in blank:
                width, alone = (0, 0) if ch == "\f" else ((width // 8 + 1) * 8, alone + 1) if ch == "\t" else (width + 1, alone + 1)
        else:
            width = alone = len(blank)
        top = indents[-1]
        if width == top[0]:
            if alone != top[1]:
                raise Reject(f"tabs and spaces disagree at {at}")
        elif width > top[0]:
            if alone <= top[1]:
                raise Reject(f"tabs and spaces disagree at {at}")
            indents.append((width, alone))
            st.push("{")
        else:
            while width < indents[-1][0]:
                indents.pop()
                st.pop("}")
            if (width, alone) != indents[-1]:
                raise Reject(f"unindent at {at} matches no outer level")

    def _tokens(self, text: str, at: int, st: Stack, indents: list[tuple[int, int]] | None, old: bool) -> int:
        """Scans to the end, or, without ``indents``, to the end of a field's expression."""
        match, n, words, ops, nl, own = _PY.match, len(text), self.old_words if old else self.words, self.ops, self.nl, self.id
        depth = 0  # brackets open
        commas = False  # of Python 2's raise and except
        while at < n:
            if old and (m := _PY2.match(text, at)):
                st.now.append((self.cmp, self.back, self.num, "")[m.lastindex - 1])
                if m.lastindex == 4:
                    st.now.pop()
                at = m.end()
                continue
            m = match(text, at)
            if m is None:
                if indents is None and depth == 0 and text[at : at + 1] == "!" or indents is None and depth == 0 and text[at:].lstrip()[:1] == "!":
                    return at + (len(text[at:]) - len(text[at:].lstrip()))
                raise Reject(f"unexpected {text[at]!r} at {at}")
            what = m.lastindex
            if what == 3:
                t = m.group(3)
                at = m.end()
                if not t.isascii() and not t.isidentifier():
                    raise Reject(f"{t!r} is no name at {at}")
                st.now.append(words.get(t, own))
                if old and t in ("raise", "except"):
                    commas = True
            elif what == 4:
                t = m.group(4)
                if indents is None and depth == 0 and t[0] == ":":
                    return m.start(4)
                at = m.end()
                st.now.append(self.old_comma if commas and t == "," and not depth else ops[t])
            elif what == 5:
                st.push(m.group(5))
                at = m.end()
                depth += 1
            elif what == 6:
                t = m.group(6)
                if indents is None and depth == 0:
                    if t != "}":
                        raise Reject(f"unmatched {t} in a field")
                    return m.start(6)
                at = m.end()
                depth -= 1
                if depth < 0:
                    raise Reject(f"unmatched {t}")
                st.pop(t)
            elif what == 8 or what == 7:
                at = m.end()
                if not depth and indents is not None:
                    st.now.append(nl)
                    commas = False
                    if at < n:
                        self._indent(m.group(8), at, indents, st)
                    elif text[m.start(7) - 2 : m.start(7)] == "\\\n":
                        raise Reject("the text ends in a continued line")
            elif what == 1:
                at = m.end()
                st.now.append(self._string(m.group(1), at))
            elif what == 9:
                t = m.group(9)
                at = m.end()
                if text[at].isalnum() or text[at] == "_":
                    if not _AFTER_NUMBER.match(text, at):
                        raise Reject(f"bad number at {at}")
                elif len(t) > 1 and t[0] == "0" and t.isdigit() and t.strip("0"):
                    raise Reject(f"bad number at {at}")
                st.now.append(self.num)
            else:
                t = m.group(2)
                parts: list[str] = []
                at = self._fields(text, m.end(), t.lstrip("fFrR"), "r" in t.lower(), parts, old)
                st.now.append(self.g.folder.fold("`", "".join(parts)) if parts else self.str)
        if depth:
            raise Reject("a bracket is never closed")
        if indents is None:
            raise Reject("a field is never closed")
        return at

    def _fields(self, text: str, at: int, quote: str, raw: bool, parts: list[str], old: bool, spec: bool = False) -> int:
        """Reads an f-string's text from ``at`` on, its fields to ``parts``; a format spec ends at its field's brace."""
        n, start = len(text), at
        while at < n:
            c = text[at]
            if c == "\\":
                e = text[at + 1 : at + 3]
                if e == "N{" and not raw:
                    at = (text.find("}", at) + 1) or n
                else:
                    at += 1 if e[:1] in ("{", "}") else 2
            elif c == "\n" and len(quote) == 1:
                raise Reject(f"an f-string is never closed at {at}")
            elif text.startswith(quote, at):
                if spec:
                    raise Reject(f"a field is never closed at {at}")
                if not raw and "\\" in text[start:at]:
                    self._escapes(text[start:at], False, at)
                return at + len(quote)
            elif c == "{":
                if not spec and text.startswith("{{", at):
                    at += 2
                    continue
                inner = Stack(self.g.folder)
                at = self._tokens(text, at + 1, inner, None, old)
                parts.append(self.g.folder.fold("(", inner.end()))
                if text[at] == "!":
                    m = re.compile(r"![sra]\s*(?=[:}])").match(text, at)
                    if m is None:
                        raise Reject(f"bad conversion at {at}")
                    at = m.end()
                if text[at] == ":":
                    at = self._fields(text, at + 1, quote, raw, parts, old, True)
                at += 1
            elif c == "}":
                if spec:
                    return at
                if not text.startswith("}}", at):
                    raise Reject(f"single brace in an f-string at {at}")
                at += 2
            else:
                at += 1
        raise Reject("an f-string is never closed")


_PY_FIRST = re.compile(r"(?:[ \t\f]*(?:\#[^\n]*)?\n)*([ \t\f]*)(?:\#[^\n]*\Z)?")
