"""Expected results for each of the assertion templates, in their order, {m} as there; fixed values of the tests' SQL."""

#: Normalised text.
NORMALISED = [
    'assert property (@(posedge clk) req |-> ##1 gnt{m});',
    'assert property (@(posedge clk) disable iff (rst) a{m} |=> b);',
    'assert property (@(posedge clk) s_eventually done{m});',
    'cover property (@(negedge clk) a ##2 b{m});',
    'assert property (@(posedge clk) valid{m} == 1);',
    'assert property (@(posedge clk) a throughout b{m});',
    'assert property (@(posedge clk) x[*2] ##1 y{m});',
    'assume property (@(posedge clk) $rose(req) |-> 1);',
    'a{m}: assert property (@(posedge clk) (a && b{m}) |-> (##1 c));',
    'assert property (@(posedge clk) req{m} |-> );',
    'assert property (@(posedge clk) a /* |-> */ == b{m})',
    'property p{m}; a ##1 b; endproperty',
    'Assert property (@(posedge clk) REQ |-> gnt{m});',
]

#: (ok, pattern, level, lowered text).
LOWERED = [
    (True, 'implies_ranged_delay', 3, "    logic svlow_ar_d1;\n    logic svlow_ar_d2;\n    logic svlow_ar_d3;\n    logic svlow_rw_d1;\n    logic svlow_rw_d2;\n    always_ff @(posedge clk) begin\n        svlow_ar_d1 <= (req);\n        svlow_ar_d2 <= svlow_ar_d1;\n        svlow_ar_d3 <= svlow_ar_d2;\n        svlow_rw_d1 <= (gnt{m});\n        svlow_rw_d2 <= svlow_rw_d1;\n    end\n    logic svlow_inited = 1'b0;\n    always_ff @(posedge clk) svlow_inited <= 1'b1;\n    always_ff @(posedge clk) begin\n        if (svlow_inited) assert (!(svlow_ar_d3) || ((gnt{m}) || svlow_rw_d1 || svlow_rw_d2));\n    end"),
    (True, 'implies_next', 4, "    logic svlow_a_d1;\n    always_ff @(posedge clk) begin\n        svlow_a_d1 <= (a{m});\n    end\n    logic svlow_inited = 1'b0;\n    always_ff @(posedge clk) svlow_inited <= 1'b1;\n    always_ff @(posedge clk) begin\n        if (svlow_inited && !(rst)) assert (!(svlow_a_d1) || (b));\n    end"),
    (False, None, 5, ''),
    (False, None, 2, ''),
    (True, 'combinational', 1, "    logic svlow_inited = 1'b0;\n    always_ff @(posedge clk) svlow_inited <= 1'b1;\n    always_ff @(posedge clk) begin\n        if (svlow_inited) assert (valid{m} == 1);\n    end"),
    (False, None, 5, ''),
    (False, None, 5, ''),
    (True, 'implies_same', 4, "    logic svlow_inited = 1'b0;\n    always_ff @(posedge clk) svlow_inited <= 1'b1;\n    always_ff @(posedge clk) begin\n        if (svlow_inited) assume (!(($rose(req))) || (1));\n    end"),
    (False, None, 5, ''),
    (True, 'implies_same', 4, "    logic svlow_inited = 1'b0;\n    always_ff @(posedge clk) svlow_inited <= 1'b1;\n    always_ff @(posedge clk) begin\n        if (svlow_inited) assert (!((req{m})) || ());\n    end"),
    (True, 'combinational', 1, "    logic svlow_inited = 1'b0;\n    always_ff @(posedge clk) svlow_inited <= 1'b1;\n    always_ff @(posedge clk) begin\n        if (svlow_inited) assert (@(posedge clk);\n    end"),
    (False, None, 0, ''),
    (True, 'implies_same', 4, "    logic svlow_inited = 1'b0;\n    always_ff @(posedge clk) svlow_inited <= 1'b1;\n    always_ff @(posedge clk) begin\n        if (svlow_inited) assert (!((REQ)) || (gnt{m}));\n    end"),
]

#: The sides of the implication exchanged.
SWAPPED = [
    'assert property (@(posedge clk) gnt{m} |-> req);',
    'assert property (@(posedge clk) disable iff (rst) b |=> a{m});',
    'assert property (@(posedge clk) s_eventually done{m});',
    'cover property (@(negedge clk) a ##2 b{m});',
    'assert property (@(posedge clk) valid{m} == 1);',
    'assert property (@(posedge clk) a throughout b{m});',
    'assert property (@(posedge clk) x[*2:4] ##1 y{m});',
    'assume property (@(posedge clk) 1 |-> $rose(req));',
    'a{m}: assert property (@(posedge clk) strong(##1 c) |-> (a && b{m}));',
    'assert property (@(posedge clk)  |-> req{m});',
    'assert property (@(posedge clk) a /* |-> */ == b{m}',
    'property p{m}; a until_with b; endproperty',
    'Assert  property (@(posedge clk) gnt{m} |-> REQ);',
]

#: Description.
DESCRIBED = [
    'when req, ##[1:3] gnt{m} must hold in the same cycle. Use signals clk, req, gnt{m}.',
    'when disable iff (rst) a{m}, b must hold in the next cycle. Use signals clk, rst, a{m}, b.',
    'that eventually done{m}. Use signals clk, done{m}.',
    'Cover the case where the sequence a ##2 b{m} occurs with a cycle delay. Use signals clk, a.',
    'that valid{m} equals 1. Use signals clk, valid{m}.',
    'that a throughout b{m}. Use signals clk, a.',
    'that the sequence x[*2:4] ##1 y{m} occurs with a cycle delay. Use signals clk, x, y{m}.',
    'Assume when req rises, 1 must hold in the same cycle. Use signals clk, req.',
    'when a and b{m}, strong(##1 c) must hold after 1 cycles This corresponds to a{m}. Use signals clk, a, c.',
    'when req{m}, the condition holds must hold in the same cycle. Use signals clk, req{m}.',
    'that assert property (a /* |- is greater than */ equals b{m}. Use signals clk, a.',
    'that property p{m}; a until b; endproperty. Use signals p{m}, a, b, endproperty.',
    'when REQ, gnt{m} must hold in the same cycle. Use signals clk, REQ, gnt{m}.',
]

#: (template's place, kind, variant at the level that it is made for).
EXPANDED = [
    (0, 'range_1_2', 'assert property (@(posedge clk) req ##[1:2] gnt{m});'),
    (0, 'range_1_3', 'assert property (@(posedge clk) req ##[1:3] gnt{m});'),
    (0, 'range_1_5', 'assert property (@(posedge clk) req ##[1:5] gnt{m});'),
    (0, 'range_2_4', 'assert property (@(posedge clk) req ##[2:4] gnt{m});'),
    (0, 'eventually', 'assert property (@(posedge clk) req |-> s_eventually (gnt{m}));'),
    (0, 'strong', 'assert property (@(posedge clk) req |-> strong(##[1:$] gnt{m}));'),
    (0, 'until', 'assert property (@(posedge clk) req |-> (req s_until gnt{m}));'),
    (0, 'until_with', 'assert property (@(posedge clk) req |-> (req until_with gnt{m}));'),
    (0, 'always', 'assert property (@(posedge clk) req |-> s_always (gnt{m}));'),
    (1, 'range_1_2', 'assert property (@(posedge clk) disable iff (rst) a{m} ##[1:2] b);'),
    (1, 'range_1_3', 'assert property (@(posedge clk) disable iff (rst) a{m} ##[1:3] b);'),
    (1, 'range_1_5', 'assert property (@(posedge clk) disable iff (rst) a{m} ##[1:5] b);'),
    (1, 'range_2_4', 'assert property (@(posedge clk) disable iff (rst) a{m} ##[2:4] b);'),
    (1, 'eventually', 'assert property (@(posedge clk) disable iff (rst) a{m} |=> s_eventually (b));'),
    (1, 'strong', 'assert property (@(posedge clk) disable iff (rst) a{m} |=> strong(##[1:$] b));'),
    (1, 'until', 'assert property (@(posedge clk) disable iff (rst) a{m} |=> (a{m} s_until b));'),
    (1, 'until_with', 'assert property (@(posedge clk) disable iff (rst) a{m} |=> (a{m} until_with b));'),
    (1, 'always', 'assert property (@(posedge clk) disable iff (rst) a{m} |=> s_always (b));'),
    (7, 'range_1_2', 'assume property (@(posedge clk) $rose(req) ##[1:2] 1);'),
    (7, 'range_1_3', 'assume property (@(posedge clk) $rose(req) ##[1:3] 1);'),
    (7, 'range_1_5', 'assume property (@(posedge clk) $rose(req) ##[1:5] 1);'),
    (7, 'range_2_4', 'assume property (@(posedge clk) $rose(req) ##[2:4] 1);'),
    (7, 'eventually', 'assume property (@(posedge clk) $rose(req) |-> s_eventually (1));'),
    (7, 'strong', 'assume property (@(posedge clk) $rose(req) |-> strong(##[1:$] 1));'),
    (7, 'until', 'assume property (@(posedge clk) $rose(req) |-> ($rose(req) s_until 1));'),
    (7, 'until_with', 'assume property (@(posedge clk) $rose(req) |-> ($rose(req) until_with 1));'),
    (7, 'always', 'assume property (@(posedge clk) $rose(req) |-> s_always (1));'),
    (8, 'eventually', 'assert property (@(posedge clk) (a && b{m}) |-> s_eventually (strong(##1 c)));'),
    (8, 'strong', 'assert property (@(posedge clk) (a && b{m}) |-> strong(##[1:$] strong(##1 c)));'),
    (8, 'until', 'assert property (@(posedge clk) (a && b{m}) |-> ((a && b{m}) s_until strong(##1 c)));'),
    (8, 'until_with', 'assert property (@(posedge clk) (a && b{m}) |-> ((a && b{m}) until_with strong(##1 c)));'),
    (8, 'always', 'assert property (@(posedge clk) (a && b{m}) |-> s_always (strong(##1 c)));'),
    (9, 'range_1_2', 'assert property (@(posedge clk) req{m} ##[1:2] );'),
    (9, 'range_1_3', 'assert property (@(posedge clk) req{m} ##[1:3] );'),
    (9, 'range_1_5', 'assert property (@(posedge clk) req{m} ##[1:5] );'),
    (9, 'range_2_4', 'assert property (@(posedge clk) req{m} ##[2:4] );'),
    (9, 'eventually', 'assert property (@(posedge clk) req{m} |-> s_eventually ());'),
    (9, 'strong', 'assert property (@(posedge clk) req{m} |-> strong(##[1:$] ));'),
    (9, 'until', 'assert property (@(posedge clk) req{m} |-> (req{m} s_until ));'),
    (9, 'until_with', 'assert property (@(posedge clk) req{m} |-> (req{m} until_with ));'),
    (9, 'always', 'assert property (@(posedge clk) req{m} |-> s_always ());'),
    (12, 'range_1_2', 'assert property (@(posedge clk) REQ ##[1:2] gnt{m});'),
    (12, 'range_1_3', 'assert property (@(posedge clk) REQ ##[1:3] gnt{m});'),
    (12, 'range_1_5', 'assert property (@(posedge clk) REQ ##[1:5] gnt{m});'),
    (12, 'range_2_4', 'assert property (@(posedge clk) REQ ##[2:4] gnt{m});'),
    (12, 'eventually', 'assert property (@(posedge clk) REQ |-> s_eventually (gnt{m}));'),
    (12, 'strong', 'assert property (@(posedge clk) REQ |-> strong(##[1:$] gnt{m}));'),
    (12, 'until', 'assert property (@(posedge clk) REQ |-> (REQ s_until gnt{m}));'),
    (12, 'until_with', 'assert property (@(posedge clk) REQ |-> (REQ until_with gnt{m}));'),
    (12, 'always', 'assert property (@(posedge clk) REQ |-> s_always (gnt{m}));'),
]

