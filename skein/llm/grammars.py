"""Rules of Python 3.13 statements and Rust 2021 items over token classes.

Token classes: N name, n number, s string, y bytes, P Q B groups in round, square and
curly brackets (their contents are token strings of their own, parsed by the
rule of their context), t lifetime, c character; keywords and operators stand
for themselves. Rules whose names begin with Ctx are the contexts.
"""

from __future__ import annotations

from skein.llm.chart import compile_rules

PYTHON = """
CtxLine : ( Simple ( ; Simple ) * ; ? | Header ) ?
Header : if Named Body | elif Named Body | else Body | while Named Body | for Targets in Stars Body | async for Targets in Stars Body | try Body | finally Body | except Body | except Test ( as N ) ? Body | except '*' Test ( as N ) ? Body | with Item ( , Item ) * Body | async with Item ( , Item ) * Body | async ? def N Q ? P ( -> Test ) ? Body | class N Q ? P ? Body | @ Named | MATCH ( Named | NStar , NStars ? ) : | CASE Pats ( if Named ) ? Body
Body : : ( Simple ( ; Simple ) * ; ? ) ?
Item : Test ( as Target1 ) ?
Simple : Stars | Targets1 = Value | Single Aug ( Yield | Stars ) | Single : Test ( = ( Yield | Stars ) ) ? | Yield | return Stars ? | del Target ( , Target ) * , ? | pass | break | continue | global N ( , N ) * | nonlocal N ( , N ) * | import Dotted As ? ( , Dotted As ? ) * | from Dots import ( '*' | P | N As ? ( , N As ? ) * ) | raise ( Test ( from Test ) ? ) ? | assert Test ( , Test ) ? | TYPE N Q ? = Test
As : as N
Dotted : N ( . N ) *
Dots : ( . | ... ) + Dotted ? | Dotted
Aug : += | -= | *= | /= | //= | %= | @= | &= | '|=' | ^= | >>= | <<= | **=
Value : Targets1 = Value | Yield | Stars
Yield : yield Stars ? | yield from Test
Targets : Target1 ( , Target1 ) * , ?
Targets1 : Target1 ( , Target1 ) * , ?
Target1 : '*' ? Target
Target : N | Primary . N | Primary Q | P | Q
Single : N | Primary . N | Primary Q | P
Stars : Star ( , Star ) * , ?
Star : '*' Arith | Test
NStars : NStar ( , NStar ) * , ?
NStar : '*' Arith | Named
Named : N := Test | Test
Test : Disj | Disj if Disj else Test | lambda Params : Test
Disj : Conj ( or Conj ) *
Conj : Inv ( and Inv ) *
Inv : not Inv | Cmp
Cmp : Arith ( Cop Arith ) *
Cop : == | != | < | > | <= | >= | in | not in | is | is not
Arith : Unary ( Bop Unary ) *
Bop : '+' | - | '*' | / | // | % | @ | << | >> | & | '|' | ^
Unary : '+' Unary | - Unary | ~ Unary | Await ( ** Unary ) ?
Await : await ? Primary
Primary : Atom | Primary . N | Primary P | Primary Q
Atom : N | n | s | y | P | Q | B | True | False | None | ...
Params : ( Front ( , Rest ) ? , ? | Rest , ? ) ?
Front : N ( , N ) * ( , / ( , N ) * ) ? ( , Dflt ) * | N ( , N ) * ( , Dflt ) + , / ( , Dflt ) * | Dflt ( , Dflt ) * ( , / ( , Dflt ) * ) ?
Dflt : N = Test
Rest : '*' N ( , ( N | Dflt ) ) * ( , ** N ) ? | '*' ( , ( N | Dflt ) ) + ( , ** N ) ? | ** N
CtxArgs : ( Args , ? | Named Comp ) ?
CtxBases : ( Args , ? ) ?
Args : Pos ( , Pos ) * ( , Kws ) ? | Kws
Pos : Named | '*' Test
Kws : Kw ( , Kw ) * ( , Kw2 ( , Kw2 ) * ) ? | Kw2 ( , Kw2 ) *
Kw : N = Test | '*' Test
Kw2 : N = Test | ** Test
Comp : ( async ? for Targets in Disj ( if Disj ) * ) +
CtxParen : Paren
Paren : ( Named | NStar , NStars ? | Yield | Named Comp ) ?
CtxWith : Paren | Item ( , Item ) * , ?
CtxTuple : ( Target | Target1 , | Target1 ( , Target1 ) + , ? ) ?
CtxTargets : Targets ?
CtxDel : ( Target ( , Target ) * , ? ) ?
CtxSingle : Single
CtxField : Yield | Stars
CtxList : NStars ? | Named Comp
CtxSub : Slice ( , Slice ) * , ?
Slice : Named | '*' Test | Test ? : Test ? ( : Test ? ) ?
CtxBrace : ( Pair ( , Pair ) * , ? ) ? | Test : Test Comp | NStars | Named Comp
Pair : Test : Test | ** Arith
CtxParams : ( DefFront ( , DefRest ) ? , ? | DefRest , ? ) ?
DefFront : Def ( , Def ) * ( , / ( , Def ) * ) ? ( , DefDflt ) * | Def ( , Def ) * ( , DefDflt ) + , / ( , DefDflt ) * | DefDflt ( , DefDflt ) * ( , / ( , DefDflt ) * ) ?
Def : N ( : Test ) ?
DefDflt : Def = Test
DefRest : '*' N ( : Star ) ? ( , ( Def | DefDflt ) ) * ( , ** Def ) ? | '*' ( , ( Def | DefDflt ) ) + ( , ** Def ) ? | ** Def
CtxImports : N As ? ( , N As ? ) * , ?
CtxTypes : Var ( , Var ) * , ?
Var : N ( : Test ) ? ( = Test ) ? | '*' N ( = Star ) ? | ** N ( = Test ) ?
Pats : One | Pat , ( Pat ( , Pat ) * , ? ) ?
Pat : '*' N | One
One : Alt ( as N ) ?
Alt : Closed ( '|' Closed ) *
Closed : - ? n ( ( '+' | - ) n ) ? | s | y | None | True | False | Name P ? | P | Q | B
Name : N ( . N ) *
CtxPatSeq : Pats ?
CtxPatList : ( Pat ( , Pat ) * , ? ) ?
CtxPatArgs : ( One ( , One ) * ( , PatKw ) * , ? | PatKw ( , PatKw ) * , ? ) ?
PatKw : N = One
CtxPatMap : ( PatPair ( , PatPair ) * ( , ** N ) ? , ? | ** N , ? ) ?
PatPair : ( - ? n ( ( '+' | - ) n ) ? | s | y | None | True | False | Name . N ) : One
CtxBlock : Stmt +
Stmt : one | decorator + ( def{} | class{} | def1 | class1 ) | def{} | class{} | def1 | class1 | For Else ? | With | If Elif * Else ? | Try ( Except + Else ? Finally ? | Finally ) | match{}
For : for{} | for1 | while{} | while1
With : with{} | with1
If : if{} | if1
Elif : elif{} | elif1
Else : else{} | else1
Try : try{} | try1
Except : except{} | except1
Finally : finally{} | finally1
CtxCases : ( case{} | case1 ) +
"""

RUST = """
CtxItem : Item
CtxMark : Item ?
CtxStmt : Let ; | E ; | Item | ;
CtxLoose : Blocky | Item | Let ;
CtxTail : E | Macro
Let : let Pat ( : T ) ? ( = E ( else B ) ? ) ?
Item : Vis ? ( Fn | Struct | use Tree ; | mod N ( B | ; ) | unsafe ? extern s ? B | extern crate N ( as ( N | _ ) ) ? ; | static mut ? N : T ( = E ) ? ; | const ( N | _ ) : T ( = E ) ? ; | type N G ? ( : Bounds ) ? Where ? ( = T ) ? Where ? ; | enum N G ? Where ? B | unsafe ? trait N G ? ( : Bounds ? ) ? Where ? B | default ? unsafe ? impl G ? ( ! ? T for ) ? T Where ? B ) | Macro ;
Item : Path ! N ? ( B ; ? | P ; | Q ; )
Vis : pub P ?
Fn : ( const | async | unsafe | default | extern s ? ) * fn N G ? P ( -> T ) ? Where ? ( B | ; )
Struct : ( struct | union ) N G ? ( Where ? B | P Where ? ; | ; )
Tree : :: ? ( ( N | crate | self | super ) :: ) * ( N | crate | self | super | '*' | B ) ( as ( N | _ ) ) ?
G : < ( Gp ( , Gp ) * , ? ) ? >
Gp : t ( : t ( '+' t ) * ) ? | N ( : Bounds ? ) ? ( = T ) ? | const N : T ( = ( n | B | - n | N | true | false ) ) ?
Where : where ( Pred ( , Pred ) * , ? ) ?
Pred : ( for G ) ? T : Bounds ? | t : t ( '+' t ) *
Bounds : Bound ( '+' Bound ) * '+' ?
Bound : t | '?' ? ( for G ) ? TyPath | '?' ? P | ~ const TyPath
T : & t ? mut ? T | & & t ? mut ? T | '*' ( const | mut ) T | Q | P | TyPath | dyn Bounds | impl Bounds | ( for G ) ? unsafe ? ( extern s ? ) ? fn P ( -> T ) ? | ! | _ | Path ! ( P | Q | B ) | for G TyPath
TyPath : :: ? TySeg ( :: TySeg ) * | < T ( as TyPath ) ? > ( :: TySeg ) +
TySeg : Id ( :: ? Ga | P ( -> T ) ? ) ?
Id : N | self | Self | super | crate
Ga : < ( Ta ( , Ta ) * , ? ) ? >
Ta : T | t | - ? n | B | s | true | false | N Ga ? = T | N Ga ? : Bounds
Path : :: ? Seg ( :: Seg ) * | < T ( as TyPath ) ? > ( :: Seg ) +
Seg : Id ( :: Ga ) ?
Macro : Path ! ( P | Q | B )
E : R | R Aop E | Jump
Aop : = | '+=' | -= | '*=' | /= | %= | ^= | &= | '|=' | << = | > > =
R : Bin | Bin Dots Bin ? | Dots Bin ?
Dots : .. | ..=
Bin : U ( Bop U ) * | ( U Bop ) * ( Jump | Closure )
Bop : '+' | - | '*' | / | % | ^ | & | '|' | & & | '|' '|' | << | > > | == | != | < | > | <= | > =
U : - U | ! U | '*' U | & mut ? U | & & mut ? U | & raw ( const | mut ) U | U as T | Post
Post : Prim | Post . ( N ( :: Ga ) ? | n | await ) | Post P | Post Q | Post '?'
Prim : n | s + | c | true | false | Path | Macro | Path B | P | Q | Blocky | _
Blocky : B | ( unsafe | const | async move ? ) B | If | match E B | ( t : ) ? loop B | ( t : ) ? while E B | ( t : ) ? for Pat in E B | t : B
If : if E B ( else ( If | B ) ) ?
Prim : let Pat = Bin
Jump : return E ? | break t ? E ? | continue t ?
Closure : ( for G ) ? static ? async ? move ? ( '|' ( Cp ( , Cp ) * , ? ) ? '|' ) ( -> T B | E )
Cp : Pat1 ( : T ) ?
Pat : '|' ? Pat1 ( '|' Pat1 ) *
Pat1 : ref ? mut ? N ( @ Pat1 ) ? | _ | .. | - ? n | s | c | true | false | & mut ? Pat1 | & & mut ? Pat1 | P | Q | Path ( P | B ) ? | Macro | Lim Dots Lim ? | Dots Lim | box Pat1 | const B
Lim : - ? n | c | Path
CtxArgs : ( X ( , X ) * , ? ) ?
X : E | Pat | T
CtxArray : ( X ( , X ) * , ? ) ? | X ; E
CtxParams : ( Par ( , Par ) * , ? ) ?
Par : Pat1 : T | ... | Self1 | Pat1 : ...
Self1 : & t ? mut ? self | mut ? self ( : T ) ?
CtxTypes : ( Vis ? T ( , Vis ? T ) * , ? ) ?
CtxFnTypes : ( FnT ( , FnT ) * , ? ) ?
FnT : ( ( N | _ ) : ) ? T | ...
CtxFields : ( Field ( , Field ) * , ? ) ?
Field : Vis ? N : T ( = E ) ?
CtxVariants : ( Variant ( , Variant ) * , ? ) ?
Variant : Vis ? N ( P | B ) ? ( = E ) ?
CtxInit : ( Init ( , Init ) * , ? ) ?
Init : ( N | n ) : ( E | Pat ) | ref ? mut ? N | .. E ?
CtxArm : Pat ( if E ) ? => E
CtxTree : ( Tree ( , Tree ) * , ? ) ?
"""

GRAMMARS = {"py": compile_rules(PYTHON), "rs": compile_rules(RUST)}
